"""Text indexes as DataFrames: postings, document lengths and corpus statistics; boolean, phrase and near search; BM25."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memengine.functions.stem import stems
from memengine.functions.text import tokens
from memengine.operators.shared import cut, kept

#: BM25 saturation and length weight, and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Scores are ranked at so many decimals, so that the order of additions does not matter.
DECIMALS = 6


#: Rows of a side that is sent to all tasks; a larger one is joined by a shuffle.
SMALL_ROWS = 200_000
#: Words of documents that a worker sorts at once.
WORDS_AT_ONCE = 200_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, to be broadcast if it has been counted to have at most ``most`` rows; for what is made of a batch of queries."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@dataclass
class Index:
    """postings(term, doc_id, dl, tf, positions) and lengths(doc_id, dl), over every document, matching or not.

    dl is the document's length; postings have it too, so that scoring needs no other table than them. A stored index has
    its postings in ``buckets`` folders by the terms' hashes, and readers of a batch's terms open only their folders.
    """

    postings: DataFrame
    lengths: DataFrame
    buckets: int | None = None

    def statistics(self) -> DataFrame:
        """One row: n_docs and average length."""
        return self.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))

    def term_statistics(self) -> DataFrame:
        """(term, df, cf): documents and occurrences of each term."""
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def of_terms(self, asked: DataFrame, term: str = "term") -> DataFrame:
        """Postings from the folders of the asked terms, all of them if the index is not stored; a job finds which folders, at
        most ``buckets``, so that the scan is pruned when it is planned."""
        if self.buckets is None:
            return self.postings
        wanted = sorted(r["bucket"] for r in asked.select(_bucket(F.col(term), self.buckets).alias("bucket")).distinct().collect())
        return self.postings.filter(F.col("bucket").isin(wanted)).drop("bucket")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of each document, made from its row alone: its terms are numbered, and places sorted by number.

    Documents are taken until they have WORDS_AT_ONCE words, so that a worker holds as much whatever a batch has.
    """
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_AT_ONCE, side="right")))
            yield _postings(batch.slice(at, to - at))
            at = to


def _postings(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column("terms")
    coded = lists.flatten().dictionary_encode()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row, term = np.repeat(np.arange(len(size)), size), coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(first, len(row))
    place = (order - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place))
    whose = pa.array(row[first])
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term[first])), batch.column("doc_id").take(whose), pa.array(size[row[first]]), pa.array(np.diff(ends)), positions], names=["term", "doc_id", "dl", "tf", "positions"])


def build_index(docs: DataFrame, stemmed: bool = False, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of the documents' tokens, or of their stems. Positions count from 0; a document without tokens has length 0.

    A document's occurrences are grouped where the document is, so nothing is shuffled.
    """
    words = tokens(F.col(text_col))
    terms = docs.select(F.col(id_col).alias("doc_id"), (stems(words) if stemmed else words).alias("terms"))
    kind = terms.schema["doc_id"].dataType.simpleString()
    postings = terms.mapInArrow(_inverted, f"term string, doc_id {kind}, dl long, tf long, positions array<int>")
    return Index(postings, terms.select("doc_id", F.size("terms").cast("long").alias("dl")))


def store_index(index: Index, folder: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Writes the index: every task adds its postings to the folders of their terms, without a shuffle."""
    index.postings.withColumn("bucket", _bucket(F.col("term"), buckets)).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode(mode).parquet(f"{folder}/postings-{buckets}")
    index.lengths.write.mode(mode).parquet(f"{folder}/lengths")


def load_index(spark: SparkSession, folder: str, buckets: int = 64) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings-{buckets}"), spark.read.parquet(f"{folder}/lengths"), buckets)


def update_index(old: Index, changed: DataFrame, removed: DataFrame, **how) -> Index:
    """The index after ``changed`` documents are new or rewritten and ``removed(doc_id)`` are gone; the rest stays as it is."""
    new = build_index(changed, **how)
    gone = removed.select("doc_id").union(changed.select(F.col(how.get("id_col", "doc_id")).alias("doc_id"))).distinct()
    keep = lambda df: df.join(gone, "doc_id", "left_anti")
    postings = old.postings.drop("bucket")
    return Index(keep(postings).unionByName(new.postings), keep(old.lengths).unionByName(new.lengths))


def _mark(term: Column, positions: Column) -> Column:
    """A number for a term's places; those of all terms of a document make the same number in any order."""
    return F.aggregate(F.transform(positions, lambda p: F.xxhash64(term, p)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def index_faults(docs: DataFrame, index: Index, stemmed: bool = False) -> DataFrame:
    """(doc_id, fault): documents that the index does not have (``missing``), that only the index has (``stale``), and those whose
    postings or length are not those of their text (``damaged``): a changed text, a lost or a foreign posting.

    Texts are cut into tokens again where they are; what is shuffled is a number for each document.
    """
    words = tokens(F.col("text"))
    terms = docs.select("doc_id", (stems(words) if stemmed else words).alias("terms"))
    whole = F.aggregate(F.transform("terms", lambda t, i: F.xxhash64(t, i)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    want = terms.select("doc_id", F.struct(F.size("terms").cast("long").alias("dl"), F.size("terms").cast("long").alias("n"), whole.alias("mark")).alias("want"))
    placed = index.postings.groupBy("doc_id").agg(F.sum("tf").alias("n"), F.bit_xor(_mark(F.col("term"), F.col("positions"))).alias("mark"), F.min("dl").alias("least"), F.max("dl").alias("most"))
    one = index.lengths.groupBy("doc_id").agg(F.max("dl").alias("dl"), F.count("*").alias("rows"))
    right = (F.col("rows") == 1) & (F.coalesce("least", "dl") == F.col("dl")) & (F.coalesce("most", "dl") == F.col("dl"))
    found = one.join(placed, "doc_id", "full_outer").select("doc_id", F.when(right, F.struct("dl", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mark", F.lit(0)).alias("mark"))).alias("have"), F.lit(True).alias("there"))
    fault = F.when(F.col("there").isNull(), "missing").when(F.col("want").isNull(), "stale").when(~F.col("want").eqNullSafe(F.col("have")), "damaged")
    return want.join(found, "doc_id", "full_outer").select("doc_id", fault.alias("fault")).filter("fault is not null")


def index_health(docs: DataFrame, index: Index, **how) -> DataFrame:
    """One row: documents in the table and in the index, how many have which fault, and whether the index is sound."""
    count = lambda f: F.count_if(F.col("fault") == f).alias(f)
    faults = index_faults(docs, index, **how).agg(count("missing"), count("stale"), count("damaged"))
    sizes = docs.agg(F.count("*").alias("n_table")).join(index.lengths.agg(F.count("*").alias("n_index")))  # one row each
    return sizes.join(faults).withColumn("sound", F.col("missing") + F.col("stale") + F.col("damaged") == 0)


def repaired(docs: DataFrame, index: Index, **how) -> Index:
    """The index after documents that it lacks or has wrong are indexed again, and those that are gone have left; the rest stays."""
    faults = cut(index_faults(docs, index, **how))  # read twice: texts are cut into tokens again once, ids are kept
    again = docs.join(faults.filter("fault <> 'stale'"), "doc_id", "left_semi")
    return update_index(index, again, faults.filter("fault = 'stale'"), **how)


def query_units(queries: DataFrame, words: Column, stemmed: bool = False) -> DataFrame:
    """(query_id, unit, terms): the units of each query, all of which a document must have.

    ``words`` is an array of quoted words; one that the tokeniser cuts into several terms is a phrase.
    """
    cut = queries.select("query_id", F.posexplode(words).alias("unit", "word")).withColumn("terms", tokens(F.col("word")))
    return cut.filter(F.size("terms") > 0).select("query_id", "unit", (stems(F.col("terms")) if stemmed else F.col("terms")).alias("terms"))


def phrase_hits(phrases: DataFrame, index: Index) -> DataFrame:
    """(phrase_id, doc_id, dl, tf): documents in which the terms of ``phrases(phrase_id, terms)`` stand in a row, and how often.

    A phrase's documents are looked for among those with its longest term. Postings of the asked terms meet by document
    once, whatever the number of phrases that have a term, and only there are places compared.
    """
    asked = phrases.select("phrase_id", "terms", F.size("terms").alias("n"))
    parts = small(asked.select("phrase_id", "n", F.posexplode("terms").alias("offset", "term")))
    postings = index.of_terms(parts)
    kinds = {r["many"] for r in asked.select((F.col("n") > 1).alias("many")).distinct().collect()}  # two at most
    one = small(parts.filter("n = 1")).join(postings, "term").select("phrase_id", "doc_id", "dl", "tf")
    if True not in kinds:
        return one
    terms = parts.filter("n > 1").select("term").distinct()
    longest = F.max_by(F.struct("term", "offset"), F.struct(F.length("term"), "term", "offset")).alias("by")
    leads = parts.filter("n > 1").groupBy("phrase_id").agg(longest).join(asked, "phrase_id").select(F.col("by.term").alias("lead"), F.col("by.offset").alias("lead_offset"), "phrase_id", "terms")
    used = postings.join(small(terms), "term").join(small(leads.select(F.col("lead").alias("term"), F.lit(True).alias("leads")).distinct()), "term", "left")
    have = used.groupBy("doc_id", "dl").agg(F.collect_list(F.struct("term", "positions")).alias("have"), F.collect_set(F.when(F.col("leads"), F.col("term"))).alias("lead"))
    met = have.select("doc_id", "dl", F.col("have.term").alias("words"), F.col("have.positions").alias("places"), F.explode("lead").alias("lead")).join(small(leads), "lead")
    of = lambda w: F.try_element_at("places", F.nullif(F.array_position("words", w), F.lit(0)).cast("int"))
    whole = met.filter(F.forall("terms", lambda w: F.array_contains("words", w)))
    start = lambda w, i: F.transform(of(w), lambda p: p - i)
    placed = F.transform("terms", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    starts = F.aggregate(placed, start(F.col("lead"), F.col("lead_offset")), lambda s, x: F.array_intersect(s, start(x["w"], x["i"])))
    rows = whole.select("phrase_id", "doc_id", "dl", F.size(starts).cast("long").alias("tf")).filter("tf > 0")
    return one.unionByName(rows) if False in kinds else rows


def near_hits(pairs: DataFrame, index: Index, distance: int = 10) -> DataFrame:
    """(pair_id, doc_id): documents in which the terms of ``pairs(pair_id, left, right)`` have at most ``distance`` words between."""
    both = pairs.select(F.explode(F.array("left", "right")).alias("term")).distinct()
    postings = index.of_terms(both).join(small(both), "term")  # places of other terms are not shuffled
    a = small(pairs).join(postings.select(F.col("term").alias("left"), "doc_id", F.col("positions").alias("p")), "left")
    b = a.join(postings.select(F.col("term").alias("right"), "doc_id", F.col("positions").alias("q")), ["right", "doc_id"])
    close = F.exists("p", lambda x: F.exists("q", lambda y: (x != y) & (F.abs(x - y) - 1 <= distance)))
    return b.filter(close).select("pair_id", "doc_id").distinct()


def prefix_terms(prefixes: DataFrame, index: Index) -> DataFrame:
    """(prefix_id, term): indexed terms that start with ``prefixes(prefix_id, prefix)``, met on their first characters."""
    cut = lambda c: F.substring(c, 1, 2)
    terms = index.postings.select("term").distinct().withColumn("head", cut("term"))
    wanted = prefixes.filter("prefix <> ''")
    long = wanted.filter(F.length("prefix") > 1).withColumn("head", cut("prefix"))
    short = wanted.filter(F.length("prefix") == 1)
    found = long.join(terms, "head").filter(F.col("term").startswith(F.col("prefix"))).select("prefix_id", "term")
    return found.unionByName(short.join(terms, F.substring("term", 1, 1) == F.col("prefix")).select("prefix_id", "term"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def match_all(units: DataFrame, index: Index, only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): BM25 of every document that has all units of a query; statistics are the whole index's.

    A query meets the documents that have its rarest unit, and looks for the others there: what is shuffled are the hits of
    units, each once, and not those of every query. ``only(doc_id)`` narrows the documents that are asked, not the statistics.
    """
    units = units.withColumn("phrase_id", F.xxhash64("terms"))
    # read twice: texts are cut into tokens once, and hits are kept
    hits = kept(phrase_hits(units.select("phrase_id", "terms").distinct(), index))
    # hits go by numbers of phrases, with what their weight is made of: small numbers take less room in a shuffle than weights
    dfs = cut(hits.groupBy("phrase_id").agg(F.count("*").alias("df"))).withColumn("no", F.monotonically_increasing_id())
    known = units.join(dfs, "phrase_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("unit", "no", "df"))).alias("units"), F.min_by("no", F.struct("df", "phrase_id")).alias("rarest"), F.max(F.col("df").isNull()).alias("lacks"))
    asked = cut(known.filter("not lacks").select("query_id", "rarest", "units"))
    weights = dfs.join(asked.select(F.col("rarest").alias("no"), F.lit(True).alias("leads")).distinct(), "no", "left").select("phrase_id", "no", "leads")
    numbered = hits.join(small(weights), "phrase_id")
    have = numbered.groupBy("doc_id").agg(F.collect_list(F.struct("no", "tf", "dl")).alias("have"), F.collect_set(F.when(F.col("leads"), F.col("no"))).alias("leads"))
    have = have if only is None else have.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    met = have.select("doc_id", "have", F.col("have.no").alias("of"), F.explode("leads").alias("rarest")).join(small(asked), "rarest")
    whole = met.filter(F.forall("units", lambda u: F.array_contains("of", u["no"]))).join(F.broadcast(index.statistics()))  # one row
    part = lambda df, hit: idf(F.col("n_docs"), df) * hit["tf"] * (K1 + 1) / (hit["tf"] + K1 * (1 - B + B * hit["dl"] / F.col("avgdl")))
    score = F.aggregate("units", F.lit(0.0), lambda s, u: s + bound(F.element_at("have", F.array_position("of", u["no"]).cast("int")), lambda hit: part(u["df"], hit)))
    return whole.select("query_id", "doc_id", F.round(score, DECIMALS).alias("score"))


def ranked(scored: DataFrame, k: int | None = None) -> DataFrame:
    """With ``rank``: best score first, then the smaller id; the first k if k is given."""
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return out if k is None else out.filter(F.col("rank") <= k)


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used, in lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def snippet(text: Column, terms: Column, width: int = 16) -> Column:
    """The window of ``width`` words with most query words, the first of the best; hits in «», cut ends as …."""

    def shown(words: Column, hit: Column, start: Column) -> Column:
        marked = F.zip_with(F.slice(words, start, width), F.slice(hit, start, width), lambda w, h: F.when(h == 1, F.concat(F.lit("«"), w, F.lit("»"))).otherwise(w))
        ends = F.when(start > 1, F.lit("…")).otherwise(F.lit("")), F.when(start <= F.size(words) - width, F.lit("…")).otherwise(F.lit(""))
        return F.concat(ends[0], F.array_join(marked, " "), ends[1])

    def best(words: Column, hit: Column) -> Column:
        last = F.greatest(F.size(words) - width, F.lit(0))
        counts = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(F.slice(hit, i + 1, width), F.lit(0), lambda a, x: a + x))
        return bound(bound(counts, lambda c: F.array_position(c, F.array_max(c)).cast("int")), lambda start: shown(words, hit, start))

    hits = lambda words: F.transform(words, lambda w: F.arrays_overlap(tokens(w), terms).cast("int"))
    found = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return bound(found, lambda words: F.when(F.size(words) == 0, F.lit("")).otherwise(bound(hits(words), lambda hit: best(words, hit))))
