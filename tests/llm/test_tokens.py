import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memengine.llm import packing, token_files, tokenizing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Hello there, General.\nLine two!", "", None, "x" * 3000, " ".join(f"w{i}!" for i in range(3000)), "a  b \n c\t d", "né <|endoftext|> x<|endoftext|>'s", "日本 text", "Hello there, General.\nLine two!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 100, t, "clash") for i, t in enumerate(TEXTS * 11)] + [(None, "no id", "clash"), (5, "again", "clash"), (5, "again", "clash")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text, end):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_tokenizer():
    e = tokenizing.Encoder(PATH, remembered=50)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([t or "" for t in TEXTS])] == [ids_of(t, 0)[:-1] for t in TEXTS]


def test_packing(spark, docs):
    rows, df = docs
    got = packing.pack_documents(df, PATH).collect()
    want = []
    for d, t, _ in rows:
        ids = ids_of(t, 2)
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(d, i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for bin_ in by.values():
        at = 0
        for offset, length in sorted(bin_):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.1 * sum(r.length for r in got) / 1024 + 1


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8, 4, 2)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 8)]


def test_sequences(spark, docs):
    rows, df = docs
    pieces = packing.token_pieces(df.limit(20), PATH, 2, with_ids=True).cache()
    out = packing.sequences(packing.pack(pieces)).collect()
    assert sum(len(r.ids) for r in out) == 4 * sum(r.length for r in pieces.collect()) and all(len(r.ids) <= 4096 for r in out)


def test_files_round_trip(spark, docs, tmp_path):
    rows, df = docs
    parts = token_files.write_tokens(df, f"file://{tmp_path}", PATH, length=64)
    got = sorted((tuple(r) for r in token_files.read_documents(parts).collect()), key=lambda r: r[1])
    want = sorted(((d, len(ids := ids_of(t, 0)), crc(ids)) for d, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in want] and sorted(map(str, want)) == sorted(str((r[0], *r[2:])) for r in got)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    first = min(parts.collect(), key=lambda r: r.part)
    reader = token_files.TokenReader(first.uri)
    ids, mask = reader.sequence(0)
    assert ids.tolist()[:3] == ids_of("no id", 0) and len(ids) == len(mask) == 64 and not ids.flags.owndata
    last, mask = reader.sequence((first.n_tokens - 1) // 64)
    assert sum(mask.to_pylist()) == (first.n_tokens - 1) % 64 + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(df, PATH).count() == 0
    assert token_files.read_documents(token_files.write_tokens(df, token_files.fresh_dir(spark, "t"), PATH)).count() == 0
