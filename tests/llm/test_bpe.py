import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from memengine.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
RNG = random.Random(1)
ODD = [
    None, "", "a", "hello world", "  x\n\n y ", "it's we'll 12345 ٣٤٥ é日本語テキスト 😀😀   x　\x85", "a" * 5000, "".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000)), "日本語" * 200,
    " " * 1000 + "x", "-" * 777, "".join(RNG.choice("aeiouéàöñ日") for _ in range(800)), "\u0000\u0001�", "<|endoftext|> <12><7>", "the cat " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.load(spark, RANKS)


def test_every_token_encodes_to_itself(library):
    """What merging all pairs of the least rank at once rests on."""
    assert sorted(RANKS.values()) == list(range(len(RANKS)))
    assert all(library._encode_single_piece(token) == [rank] for token, rank in RANKS.items())


@pytest.mark.parametrize("known", [0, bpe.KNOWN])
def test_ids_and_bytes_of_odd_texts(spark, ranks, library, known):
    rows = [(i, t, [0], 1.5) for i, t in enumerate(ODD)] + [(3, ODD[3], [1], None), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, n_tokens double").repartition(3)
    got = bpe.encode(docs, ranks, PATTERN, known).withColumn("back", bpe.decode(F.col("ids"), ranks)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "ids", "n_tokens", "back"}
    for r in got:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode()


def test_long_and_short_words_have_one_result(spark, ranks, library):
    words = ["".join(RNG.choice("abcdefghinorst") for _ in range(RNG.randint(1, 60))) for _ in range(100)] + ["ab" * 40, "aaa", "zzzzzzzz"]
    w = F.col("w")
    for r in spark.createDataFrame([(x,) for x in words], "w string").select("w", bpe._one_by_one(w, ranks).alias("a"), bpe._all_at_once(w, ranks).alias("b")).collect():
        assert r.a == r.b == library._encode_single_piece(r.w.encode())


def test_ids_need_not_be_whole_characters(spark, ranks, library):
    ids = [[], [RANKS[b"\xe6"]], library.encode_ordinary("日")[:1] + [0]]
    got = [bytes(r[0]) for r in spark.createDataFrame([(x,) for x in ids], "ids array<int>").select(bpe.decode(F.col("ids"), ranks)).collect()]
    assert got == [library.decode_bytes(x) for x in ids]


def test_query_against_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = bpe.query(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark, ranks):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), ranks, PATTERN).count() == 0
