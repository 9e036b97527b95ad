import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazardframe.llm import storage, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 7, 8, 11, 16, 17, 24, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = tokenfile.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (tokenfile.unpack(data, bits, 1001) == ids).all()


TEXTS = [
    "", " ", "  two  blanks ", "a\nb", "a\n\nb", "a \n b", "tab\tx", "don't we'll 'tis", "x y  z", "a  b", "é è\nñ ß", "日本 語\n日", "<|endoftext|>",
    "a <|endoftext|> b<|endoftext|>", "1 22 333.4 5,6", "end. \nNext", "w" * 300 + " " + "v" * 300, "a\r\nb\x0bc\x85d \x1c e", "emoji 😀 😀\n😀", "× ÷ x×y", "A.B. C,", ".", ", .", "\n", "a\n",
]


def test_encoder_equals_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    coder = tokenfile.Encoder(PATH)
    assert coder.cuttable
    for _ in range(2):  # the second time from the table of pieces
        ids, counts = coder.encode(pa.array([*TEXTS, None]), 0)
        ends = np.cumsum(counts)
        for text, n, e in zip([*TEXTS, ""], counts, ends):
            assert ids[e - n : e].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0], repr(text)


def test_a_word_is_asked_for_once_whatever_stop_stands_behind_it(monkeypatch):
    coder, asked = tokenfile.Encoder(PATH), []
    ask = coder._encoded
    monkeypatch.setattr(coder, "_encoded", lambda data, s, e: asked.extend(data[a:b].tobytes().decode() for a, b in zip(s, e)) or ask(data, s, e))
    coder.encode(pa.array(["one\nstränge one. stränge, one, stränge. a.b 3.4,x. ×. 's."]), None)
    coder.encode(pa.array(["stränge one, stränge. one"]), None)
    assert sorted(asked) == sorted(["one", "\n", "stränge", " one", ".", " stränge", ",", " a", ".b", " 3.4,x", " ×.", " 's"])


@pytest.mark.parametrize("bits, most_ids", [(2, 6_000_000), (20, 50), (4, 5)])
def test_a_full_table_of_pieces_changes_nothing(monkeypatch, bits, most_ids):
    monkeypatch.setattr(tokenfile, "SLOT_BITS", bits)
    monkeypatch.setattr(tokenfile, "MAX_CACHED_IDS", most_ids)
    tokenizer, coder = Tokenizer.from_file(PATH), tokenfile.Encoder(PATH)
    random = np.random.default_rng(7)
    alphabet = list("abcdeé×ßà.,;'s 1\n日") + [" the", " on.", ", ", "ly "]
    for _ in range(20):
        texts = ["".join(random.choice(alphabet, random.integers(0, 120))) for _ in range(20)]
        ids, counts = coder.encode(pa.array(texts), None)
        ends = np.cumsum(counts)
        for text, n, e in zip(texts, counts, ends):
            assert ids[e - n : e].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(coder.ids) <= most_ids


def test_another_tokenizer_gets_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, tokenizer = tokenfile.Encoder(path), Tokenizer.from_file(path)
    ids, counts = coder.encode(pa.array(["Some words, here", None]), None)
    assert not coder.cuttable and ids.tolist() == tokenizer.encode("Some words, here", add_special_tokens=False).ids and counts.tolist()[1] == 0


def brute(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, ids in sorted(((r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((doc_id, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    return out


def test_files_hold_every_row(spark, odd, odd_rows):
    path = storage.shared_folder(spark, "t")
    tokenfile.write_ids(tokenfile.encode_texts(odd, PATH), path, 50_257)
    got = tokenfile.read_ids(spark, path).withColumn("crc", F.crc32("ids")).orderBy("start").collect()
    assert sorted(((r.doc_id, r.n_tokens, r.crc) for r in got), key=str) == sorted(brute(odd_rows), key=str)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    known = [r.doc_id for r in got]
    assert known == sorted(known, key=lambda i: (i is not None, i or 0))


def test_random_access(spark, odd):
    path = storage.shared_folder(spark, "t")
    tokenfile.write_ids(tokenfile.encode_texts(odd, PATH).coalesce(1), path, 50_257)
    manifest = tokenfile.read_manifest(path)
    file = tokenfile.PackedFile(f"{path}/{manifest['files'][0]['name']}")
    whole = file.ids(0, file.n_ids)
    assert file.bits == 16 and len(whole) == manifest["files"][0]["ids"]
    for a, b in ((0, 1), (5, 5), (65_530, 65_545), (file.n_ids - 3, file.n_ids)):
        assert (file.ids(a, b) == whole[a:b]).all()


def test_the_data_source_reads_and_writes_the_same(spark, odd):
    spark.dataSource.register(tokenfile.PackedIds)
    path = storage.shared_folder(spark, "t")
    tokenfile.encode_texts(odd, PATH).write.format("packed_ids").option("vocabulary", 50_257).mode("append").save(path)
    one = sorted(map(str, spark.read.format("packed_ids").load(path).collect()))
    assert one and one == sorted(map(str, tokenfile.read_ids(spark, path).collect()))


def test_empty(spark, empty):
    path = storage.shared_folder(spark, "t")
    tokenfile.write_ids(tokenfile.encode_texts(empty, PATH), path, 50_257)
    assert tokenfile.read_ids(spark, path).count() == 0


def test_an_id_outside_the_vocabulary_is_refused():
    writer = tokenfile.PackedIdsWriter({"path": "/nowhere", "vocabulary": "16"})
    assert writer.bits == 4


def test_texts_go_to_files_in_one_step(spark, odd, monkeypatch):
    plans, kept = [], type(odd).collect
    monkeypatch.setattr(type(odd), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    one, two = storage.shared_folder(spark, "t"), storage.shared_folder(spark, "t")
    tokenfile.write_ids(tokenfile.encode_texts(odd, PATH), one, 50_257)
    tokenfile.write_texts(odd, two, PATH, 50_257)
    assert [p.count("MapInArrow") for p in plans] == [2, 1]  # each is a Python process for every core
    rows = [sorted(map(str, kept(tokenfile.read_ids(spark, path)))) for path in (one, two)]
    assert rows[0] and rows[0] == rows[1]
