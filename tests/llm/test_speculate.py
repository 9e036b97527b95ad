import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazardframe.llm import speculate

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  two  blanks ", "a\nb", "a\n\nb", "a \n b", "tab\tx", "don't we'll 'tis I'LL x.'s", "é è\nñ ß Ünï×÷", "日本 語\n日", "<|endoftext|>", "a <b <|endoftext| >",
    "a <|endoftext|> b<|endoftext|>", "x<|endoftext|>y.", "1 22 333.4 5,6 abc123,x", "w" * 300 + " " + "v" * 300, "a\r\nb\x0bc\x85d \x1c e\x00\x01\x7f", "emoji 😀 😀\n😀",
    "aaaaaaaaaaaaaaaaa aaaa aaaaaaa", "=========== ------- " + "=" * 90, "ÃÂÃÂÃÂÃÂ", " \n \n\n  x", None, "end. \nNext, A.B. C,", "xyxyzzq" * 40, "²³½ Ⅷ ٣",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def rows(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for n, e in zip(counts, ends)]


def test_encoding_equals_the_library(library):
    r = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aab ", "ab1 2\n.,;'\"-_ ", "aé日😀   ñß\n", "etaoin shrdlu ETAOIN"]
    texts = TEXTS + ["".join(r.choice(alphabets[k % 5]) for _ in range(r.randrange(1, 80))) for k in range(1_500)]
    coder = speculate.Speculator(PATH)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from the table of pieces
        assert rows(*coder.encode(pa.array(texts))) == want


def test_every_token_alone_and_every_kind_of_word(library):
    v = speculate.Vocabulary(PATH)
    assert v.sound[:50_256].all()
    words = [f"{a}{b}".encode() for a in ("th", "ing", "ξ", "zq", "aa") for b in ("e", "ed", "aaa", "x9", "日", "q" * 70)]
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    exact = [v._merged_alone(np.frombuffer(w, np.uint8)).tolist() for w in words]
    assert rows(*v.words(data, size)) == exact
    merged = speculate._assembled(len(words), v._merged(data, np.cumsum(size) - size, size, np.arange(len(words))))
    assert rows(*merged) == exact


def test_seams(library):
    """A pair of tokens passes exactly if the library's merging of their bytes gives the pair back."""
    v, r = speculate.Vocabulary(PATH), random.Random(5)
    plain = [i for i in range(50_256) if library.id_to_token(i).isascii() and library.id_to_token(i).isalpha()]
    short = [i for i in plain if len(library.id_to_token(i)) <= 3]
    pairs = [(r.choice(p), r.choice(q)) for p, q in [(plain, plain), (short, short), (short, plain), (plain, short)] * 500]
    passes = v._first_merge(*(np.array(x) for x in zip(*pairs))) < 0
    for (a, b), ok in zip(pairs, passes):
        got = library.encode(library.id_to_token(a) + library.id_to_token(b), add_special_tokens=False).ids
        assert ok == (got == [a, b]), (a, b)


def test_ambiguous_tokens_and_other_tokenizers(tmp_path, library):
    """Where two rules make one token, words that hold it are merged exactly; files of another kind are refused."""
    file = json.loads(library.to_str())
    bytes_ = [t for t in file["model"]["vocab"] if len(t) == 1]
    file["added_tokens"] = []
    file["model"]["vocab"] = {t: i for i, t in enumerate([*bytes_, "ab", "bc", "abc", "abcd", "cd"])}
    file["model"]["merges"] = [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"], ["c", "d"], ["abc", "d"]]
    path = str(tmp_path / "two.json")
    (tmp_path / "two.json").write_text(json.dumps(file))
    other, coder = Tokenizer.from_file(path), speculate.Speculator(path)
    texts = ["abcd abc bcd", "abab cdcd abcdabcd", "dcba abccd"]
    assert rows(*coder.encode(pa.array(texts))) == [other.encode(t).ids for t in texts]
    for kind in ("word_bpe_49k.json",):
        with pytest.raises(ValueError):
            speculate.Vocabulary(public_tokenizers.path(kind))


def test_decoding_any_ids(library):
    v, r = speculate.Vocabulary(PATH), random.Random(9)
    ids = [[r.randrange(50_300) for _ in range(r.randrange(9))] for _ in range(400)] + [[50_256, 10, 50_256]]
    packed = pa.array([np.array(x, "<u4").tobytes() for x in ids] + [None], pa.binary())
    assert speculate.decoded(v, packed).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in ids] + [""]


def test_odd_rows(spark, odd, odd_rows, empty, library):
    got = speculate.decode(speculate.encode(odd, PATH), PATH).collect()
    want = [(r[0], ids, library.decode(ids, skip_special_tokens=False)) for r in odd_rows for ids in [library.encode(r[1] or "", add_special_tokens=False).ids]]
    assert sorted(str((x["id"], np.frombuffer(x["ids"], "<u4").tolist(), x["text"])) for x in got) == sorted(map(str, want))
    assert all(x["n_tokens"] * 4 == len(x["ids"]) for x in got)
    assert speculate.decode(speculate.encode(empty, PATH), PATH).count() == 0


def test_query(spark, entry_queries, library):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in entry_queries["op12_bpe_round_trip"](spark, folder).collect()}
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(texts)
    for r in texts:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
