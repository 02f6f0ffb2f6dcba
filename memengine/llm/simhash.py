"""Near-duplicate documents by SimHash fingerprints of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import LOWER_BYTES, as_bytes, chunks, cut, lookup, span_hash, table, without, words, worker_state
from memengine.llm.components import connected_components
from memengine.llm.hamming import hamming_links
from memengine.llm.lines import BUCKET, STRICT, Lines, block_keys, bucket_links

SEED = 42
#: Shingles that one numpy step counts the bits of.
STEP = 1 << 16
#: Jaccard similarity of word shingles at which documents are near copies, the words of a shingle, and the bits of 120 in which
#: candidates differ at most: at this similarity one word in forty is another, and 12 bits differ on average.
SIMILARITY, WORDS, DIFFER = 0.8, 5, 30
#: Documents of one family, and words in them, that a task compares; a larger family is compared block by block.
FAMILY, FAMILY_WORDS = 512, 2_000_000
_SOLID = lookup(lambda c: c not in b" \t\n\r\x0b\x0c")


def fingerprint(body: bytes, shingle: int = 3) -> int:
    """A bit is 1 if over half of the shingles' XXH64 values have it; 0 for a text without words.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; fewer than ``shingle`` words are one shingle.
    """
    words = body.lower().split()
    if not words:
        return 0
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    parts = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else iter([words])
    count = np.zeros(64, np.int64)
    for _ in range(0, n, STEP):
        h = np.array([digest(b" ".join(p), SEED) for p in islice(parts, STEP)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state()
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("body")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 3, differ: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: documents whose fingerprints differ in at most ``differ`` bits link.

    component_id is the smallest doc_id that links reach, over any path, the row's own included. Equal fingerprints
    meet once: links are sought between distinct values. Null and empty texts have fingerprint 0 and link like any
    other; rows that repeat are each answered; a row with a null id links too, and has a null component only if every
    row that it reaches has a null id.
    """
    prints = cut(as_bytes(docs).mapInArrow(_fingerprints(shingle), "doc_id long, fp long"))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(hamming_links(distinct.select("fp"), differ, blocks))
    linked = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _documents(data: np.ndarray, at: np.ndarray) -> Lines | None:
    """Whole texts as runs of words; a text without words is none."""
    low = LOWER_BYTES[data]
    start, end, count = words(low, at, _SOLID)
    if not len(start):
        return None
    of = np.flatnonzero(count)
    last = np.cumsum(count[of])
    return Lines(of, of, span_hash(low, start, end), start, end, last - count[of], last)


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h1, h2, fp, n) of each row: two hashes of its words in order, the SimHash of its pairs of words, and how many; 0 without words."""
    for batch in batches:
        for a, b, data, at in chunks(batch.column("body")):
            out = np.zeros((4, b - a), np.uint64)
            if (x := _documents(data, at)) is not None:
                out[:, x.of] = x.identity(), span_hash(x.h, x.first, x.last, base=0xC2B2AE3D27D4EB4F), x.fingerprint(), x.size.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(v.view(np.int64)) for v in out)], names=["doc_id", "h1", "h2", "fp", "n"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, sk) of the blocks of every text of more than a few words; a task gives those of a text that repeats once."""
    known: set[int] = set()
    for batch in batches:
        for _, _, data, at in chunks(batch.column("body")):
            if (x := _documents(data, at)) is not None:
                doc, key, *rest = block_keys(x, data)
                new = np.array([not (h in known or known.add(h)) for h in x.identity().tolist()])[doc] & (key & np.uint64(3) == STRICT)
                yield pa.RecordBatch.from_arrays([pa.array(v[new].view(np.int64)) for v in (key, *rest)], names=["key", "fp", "sk"])


def _shingles(body: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; fewer words than that are one shingle."""
    x = _documents(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
    first = np.arange(max(1, len(x.h) - shingle + 1))
    return np.unique(span_hash(x.h, first, np.minimum(first + shingle, len(x.h))))


def _star(ids: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray], least: float, src: list, dst: list) -> None:
    """Links between similar sets that join the same documents as all such pairs do; if there are sides, of different ones.

    Only documents that no group has reached yet are compared, so that a dense group costs about its size.
    """
    sizes = np.array([len(x) for x in sets])
    left = np.arange(len(ids))
    while len(left) > 1:
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            p = edge.pop()
            may = np.minimum(sizes[left], sizes[p]) >= least * np.maximum(sizes[left], sizes[p])
            if side is not None:
                may &= side[left] != side[p]
            if may.any():
                asked = left[may]
                end = np.cumsum(sizes[asked])
                at = np.minimum(np.searchsorted(sets[p], every := np.concatenate([sets[i] for i in asked])), sizes[p] - 1)
                both = np.add.reduceat((sets[p][at] == every).astype(np.int64), end - sizes[asked])
                may[may] = both >= least * (sizes[asked] + sizes[p] - both) - 1e-9
            edge.extend(left[may])
            src.extend(ids[left[may]].tolist())
            dst.extend([int(ids[p])] * int(may.sum()))
            left = left[~may]


def _verify(shingle: int, least: float):
    """Links within each family or pair of blocks, from rows sorted by (root, a, b)."""

    def links(key: tuple, rows: list) -> pd.DataFrame:
        src, dst = [], []
        if len(rows) > 1:
            ids, own, bodies = zip(*rows, strict=True)
            _star(np.array(ids), np.array(own) if key[1] < key[2] else None, [_shingles(x, shingle) for x in bodies], least, src, dst)
        return pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker_state()
        now, held = None, []
        for batch in batches:
            for root, a, b, own, node, body in zip(*(batch[c] for c in ("root", "a", "b", "own", "h1", "body")), strict=True):
                if (root, a, b) != now:
                    yield links(now, held)
                    now, held = (root, a, b), []
                held.append((node, own, body))
        yield links(now, held)

    return run


def similar_documents(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, differ: int = DIFFER, bucket: int = BUCKET, family: int = FAMILY) -> DataFrame:
    """(doc_id, component_id) for each row: documents link if their sets of word shingles have a Jaccard similarity of ``similarity``.

    A document deals its words to blocks that are SimHashes of their own, so that an edit leaves most of them as they were.
    Documents that share a block and are at most ``differ`` bits of two further SimHashes apart are candidates; their texts
    decide. component_id is the smallest doc_id that links reach, the row's own included. Texts of the same words are one,
    as are all without words; those of up to 8 words link only so. Rows that repeat are each answered; a row with a null
    id links too, and has a null component only if every row that it reaches has a null id.
    """
    bodies = as_bytes(docs)
    prints = cut(bodies.mapInArrow(_identities, "doc_id long, h1 long, h2 long, fp long, n long"))
    classes = cut(prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    near = connected_components(bucket_links(bodies.select("body").mapInArrow(_keyed, "key long, fp long, sk long"), differ, bucket).select("src", "dst"))
    shared = classes.filter("h1 <> 0").groupBy("fp").agg(F.count("*").alias("m"))
    families = shared.join(near, shared["fp"] == near["node"], "left").filter("m > 1 or root is not null").select("fp", F.coalesce("root", "fp").alias("root"))
    members = cut(classes.filter("h1 <> 0").join(families, "fp").select("h1", "h2", "root", "least", "n"))
    # any row of a class has its words: those of the least id, or of none where no row has one
    wanted = members.join(prints.select("doc_id", "h1", "h2"), ["h1", "h2"]).filter(F.col("doc_id").eqNullSafe(F.col("least"))).select(F.col("doc_id").alias("id"), "h1", "h2", "root").distinct()
    texts = bodies.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id"))).mapInArrow(_of_class, "h1 long, root long, body binary")
    parts = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / family, F.sum("n") / FAMILY_WORDS)).cast("int").alias("parts"))
    own = F.pmod("h1", F.col("parts")).cast("int")
    dealt = texts.join(parts, "root").withColumn("own", own).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("root", F.least("own", "j").alias("a"), F.greatest("own", "j").alias("b"), "own", "h1", "body").dropDuplicates(["root", "a", "b", "h1"])
    links = dealt.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "h1").mapInPandas(_verify(shingle, similarity), "src long, dst long")
    linked = connected_components(links)
    rooted = cut(classes.join(linked, classes["h1"] == linked["node"], "left").select("h1", "h2", "least", F.coalesce("root", "h1").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(smallest, "root").select("h1", "h2", "component_id"), ["h1", "h2"]).select("doc_id", "component_id")


def _of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text is of the class that their id stands for; rows that share an id may have other texts."""
    for batch in batches:
        keep = []
        for i, (body, h1) in enumerate(zip(batch.column("body"), batch.column("h1").to_pylist(), strict=True)):
            text = body.as_py()
            x = _documents(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            if x is not None and int(x.identity().view(np.int64)[0]) == h1:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("h1", "root", "body")], names=["h1", "root", "body"])


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The documents that no near copy with a smaller id has, with all their columns. A row without an id stays."""
    gone = similar_documents(docs, **how).filter("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, gone)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
