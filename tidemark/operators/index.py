"""Full-text index and BM25 as relations: postings, document lengths, document frequencies.

An index is built once for a snapshot and stored: postings bucketed by record, frequencies, and the two numbers of the corpus.
Document frequency counts all indexed records, whatever their scope or status. Texts are dealt to the buckets before they are
cut into tokens, so that no posting is ever exchanged, and there are as many buckets as records need, so that one is sorted in memory.

Scoring joins query terms, which are broadcast where they are few, with postings, and sums scores by (query, record) inside of the
buckets before anything is ranked with a window whose limit Spark pushes below the exchange (WindowGroupLimit). A term that most
records have adds almost nothing (its weight is a floor), so such terms are added for the records that the others have put near the
top; where they could decide who gets there, which a bound tells, all of a query's terms are scored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, fold, grams, tokens
from ..plans import bucketed
from ..plans.snapshots import Snapshots
from ..plans.staging import FEW, broadcast_blocks, if_few, shared_dir, staged, union_all

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Records of a bucket, about; the buckets are as many as that takes, or as the session's partitions.
BUCKET = 4096
#: Rows kept beyond the best k before the floor terms are added.
SPARE = 64
#: A quote is looked for in all texts where one of so many records or fewer is a candidate, and candidates are not few.
SHARE = 16
#: The layout of stored indexes; whoever changes what they hold, or how texts become terms, changes it.
LAYOUT = "postings-by-record-1"
_POSTING = "term STRING, id {id}, tf BIGINT, doc_len BIGINT, places ARRAY<INT>"


def tokenized(records: DataFrame, text: Column) -> DataFrame:
    return records.select("id", tokens(text).alias("tokens"))


def postings(records: DataFrame, *text_cols: str, text: Column | None = None, places: bool = False) -> DataFrame:
    """(id, term, tf, doc_len, places): one row for each record and distinct term; its places only where they are asked for."""
    own = tokenized(records, F.concat_ws(" ", *text_cols) if text is None else text)
    # a record's equal terms are put side by side and counted in its row: nothing is grouped over rows
    term = (lambda x: x["term"]) if places else (lambda x: x)
    marked = F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("place"))) if places else F.col("tokens")
    own = own.select("id", F.size("tokens").cast("long").alias("doc_len"), F.sort_array(marked).alias("s"))
    nth = lambda i: term(F.element_at("s", i))
    every = F.slice(F.sequence(F.lit(1), F.size("s") + 1), F.lit(1), F.size("s"))
    starts = F.filter(every, lambda i: (i == 1) | (nth(i) != nth(F.greatest(i - 1, F.lit(1)))))
    own = own.withColumn("starts", F.concat(starts, F.array(F.size("s") + 1)))
    first = F.slice("starts", 1, F.size("starts") - 1)

    def posting(i: Column, j: Column) -> Column:
        n = F.element_at("starts", j + 2) - i
        at = F.transform(F.slice("s", i, n), lambda x: x["place"]) if places else F.lit(None).cast("array<int>")
        return F.struct(nth(i).alias("term"), n.cast("long").alias("tf"), at.alias("places"))

    # explode() would have its texts enriched and cut twice, for a filter that Spark infers from it and moves below
    rows = own.select("id", "doc_len", F.explode_outer(F.transform(first, posting)).alias("p")).where("p is not null")
    return rows.select("id", "p.term", "p.tf", "doc_len", "p.places")


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(requests: DataFrame, limit: int = 64) -> DataFrame:
    """(query_id, term): the first ``limit`` distinct tokens of each query."""
    found = F.slice(F.array_distinct(tokens(F.col("query"))), 1, limit)
    return requests.select("query_id", F.explode(found).alias("term"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


@dataclass(frozen=True)
class Index:
    """A stored index: postings (term, id, tf, doc_len, places), frequencies (term, df), and the corpus's numbers."""

    postings: DataFrame
    frequencies: DataFrame
    n_docs: float
    avg_len: float

    @staticmethod
    def build(records: DataFrame, *text_cols: str, text: Column | None = None, places: bool = False, path: str | None = None) -> Index:
        spark = records.sparkSession
        path = path or f"{shared_dir(spark)}/tidemark/index-{uuid.uuid4().hex}"
        n = records.count()
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET), 1)
        own = postings(records.repartition(buckets, "id"), *text_cols, text=text, places=places)
        # ids are as the records have them
        kind = own.schema["id"].dataType.simpleString()
        bucketed.write(own.select("term", "id", "tf", "doc_len", "places"), f"{path}/postings", _POSTING.format(id=kind), ["id"], buckets)
        made = spark.read.schema(_POSTING.format(id=kind)).parquet(f"{path}/postings")
        document_frequencies(made).write.parquet(f"{path}/frequencies")
        length = made.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n")).head().n
        spark.createDataFrame([(float(n), length / n if n else 0.0, buckets, kind)], "n_docs double, avg_len double, buckets int, id_type string").coalesce(1).write.parquet(f"{path}/numbers")
        return Index.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        found = spark.read.parquet(f"{path}/numbers").head()
        rows = bucketed.read(spark, f"{path}/postings", _POSTING.format(id=found.id_type), ["id"], found.buckets)
        return Index(rows, spark.read.schema("term STRING, df BIGINT").parquet(f"{path}/frequencies"), found.n_docs, found.avg_len)

    def known(self, terms: DataFrame) -> tuple[DataFrame, int]:
        """The terms (term, ...) that some record has, with their df, and how many rows were asked for: no more are there."""
        asked = staged(terms, "asked")
        n = asked.count()
        return staged(self.frequencies.join(if_few(asked, n), "term").select(*terms.columns, "df"), "known"), n

    def having(self, known: DataFrame, n: int) -> DataFrame:
        """The postings of known terms (term, df, ...), of which there are n at most: those are broadcast if they are few, and the postings are read where they lie."""
        return self.postings.join(if_few(known, n), "term")

    def of(self, terms: DataFrame) -> DataFrame:
        """The postings of terms (term, ...), with the columns of ``terms`` and df."""
        return self.having(*self.known(terms))

    def frequencies_of(self, terms: DataFrame, ceiling: int) -> DataFrame:
        """(term, df): how many records have a term, cut off above the ceiling; 0 for terms of none."""
        own = terms.select("term").distinct()
        met = own.join(self.known(own)[0], "term", "left")
        return met.select("term", F.least(F.coalesce("df", F.lit(0)), F.lit(ceiling + 1)).cast("long").alias("df"))

    def gain(self) -> Column:
        f = F.col("tf").cast("double")
        weight = idf(F.lit(self.n_docs), F.col("df").cast("double"))
        return weight * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("doc_len") / F.lit(self.avg_len)))

    def is_floor(self) -> Column:
        return idf(F.lit(self.n_docs), F.col("df").cast("double")) <= IDF_FLOOR

    def scores(self, terms: DataFrame) -> DataFrame:
        """(query_id, id, score): the positive BM25 score of every record that shares a term with a query (query_id, term)."""
        times = F.col("times") if "times" in terms.columns else F.lit(1)
        return self.of(terms).groupBy("query_id", "id").agg(F.round(F.sum(self.gain() * times), 6).alias("score"))


def versions(spark: SparkSession, root: str) -> Snapshots:
    """Where indexes of snapshots are kept: version n of an index is that of version n of the records."""
    return Snapshots(spark, root)


def stored(spark: SparkSession, root: str, version: int, records: DataFrame, *text_cols: str, **how) -> Index:
    """The index of a snapshot's records: opened if it has been built before, else built, and swapped in whole by a rename."""
    own = versions(spark, root)
    path = f"{own.root}/v{version:08d}"
    if version not in own.versions():
        made = f"{own.root}/staging-{uuid.uuid4().hex}"
        Index.build(records, *text_cols, path=made, **how)
        own.publish(made, version)
    return Index.open(spark, path)


def top(scored: DataFrame, k: int, *partition: str, order: tuple = ()) -> DataFrame:
    """The k best rows of each partition, with their rank; ties by id."""
    by = Window.partitionBy(*partition).orderBy(F.desc("score"), *order, "id")
    return scored.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def best(
    terms: DataFrame,
    index: Index,
    k: int,
    requests: DataFrame | None = None,
    records: DataFrame | None = None,
    statuses: tuple[str, ...] = (),
    by_status: bool = False,
    order: tuple = (),
) -> DataFrame:
    """The k best records of each query (query_id, term), or of each query and status, as ``top`` of all scores would give them.

    ``requests``, ``records`` and ``statuses`` limit the records to those that a request may see. Terms of a floor weight are only joined for records that
    the other terms have put among the best k and SPARE more, unless they could lift another record there.
    """
    times = F.col("times") if "times" in terms.columns else F.lit(1)
    partition = ("query_id", "status") if by_status else ("query_id",)
    known, n_terms = index.known(terms)
    weighed = known.withColumn("floor", index.is_floor())
    bound = weighed.groupBy("query_id").agg((F.sum(F.when(F.col("floor"), times)) * (IDF_FLOOR * (K1 + 1)) + 2e-6).alias("bound"))

    def seen(scored: DataFrame) -> DataFrame:
        return scored if records is None else scoped(scored, requests, records, statuses)

    first = index.having(weighed.where("not floor").drop("floor"), n_terms).groupBy("query_id", "id").agg(F.sum(index.gain() * times).alias("part"))
    head = staged(top(seen(first.withColumn("score", F.round("part", 6))), k + SPARE, *partition, order=order), "head")
    # a partition is settled if no record outside of the head can come to the best k by its floor terms
    edges = head.groupBy(*partition).agg(
        F.count("*").alias("n"), F.min(F.when(F.col("rank") <= k, F.col("score"))).alias("kth"), F.min("score").alias("last")
    ).join(bound, "query_id")
    reach = F.when(F.col("n") == k + SPARE, F.col("last")).otherwise(0.0) + F.col("bound")
    sure = F.col("bound").isNull() | ((F.col("n") >= k) & (F.col("kth") > reach))
    settled = edges.where(sure).groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == (len(statuses) if by_status else 1))
    none = bound.where("bound is null").select("query_id")
    settled = staged(settled.select("query_id").unionByName(none).distinct(), "settled")

    floor = weighed.where("floor").drop("floor")
    wanted = head.join(settled, "query_id", "left_semi")
    more = index.having(floor.join(settled, "query_id", "left_semi"), n_terms).select("query_id", "id", (index.gain() * times).alias("more"))
    added = more.join(wanted.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id", "id").agg(F.sum("more").alias("more"))
    near = wanted.join(added, ["query_id", "id"], "left")
    near = near.withColumn("score", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 6)).drop("part", "more", "rank")
    rest = weighed.drop("floor", "df").join(settled, "query_id", "left_anti")
    if not rest.isEmpty():
        near = near.unionByName(seen(index.scores(rest)).select(near.columns))
    return top(near, k, *partition, order=order)


def visible(requests: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, record columns) of what a request may see: records of scope user, and those of its project.

    Two equi joins in place of one join on ``scope = 'user' or project``, which would be a nested loop. Records of scope
    user are met by every request, which are a stated query set, in blocks of bounded size.
    """
    own = requests.select("query_id", F.col("project_key").alias("for_project"))
    shared = records.where("scope = 'user'")
    everyones = union_all([shared.crossJoin(b) for b in broadcast_blocks(own.select("query_id"), "query_id")])
    projects = records.where("scope <> 'user'").join(own, F.col("project_key") == F.col("for_project")).drop("for_project")
    return everyones.unionByName(projects)


def scoped(scored: DataFrame, requests: DataFrame, records: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Scores of the records that each request may see, in the given states; the scores themselves stay global."""
    own = records.where(F.col("status").isin(*statuses)).select("id", "scope", "project_key", "status", "verified_count")
    met = scored.join(own, "id").join(requests.select("query_id", F.col("project_key").alias("for_project")), "query_id")
    return met.where((F.col("scope") == "user") | (F.col("project_key") == F.col("for_project"))).drop("for_project")


def pool_size(limit: int) -> int:
    return max(8 * limit, 24)


def status_pools(terms: DataFrame, index: Index, limit: int, requests: DataFrame, records: DataFrame, statuses: tuple[str, ...] = ("active", "stale")) -> DataFrame:
    """A relevance pool of each state, then all of a query's pools in one order: active first, then by score."""
    ranked = best(terms, index, pool_size(limit), requests, records, statuses, by_status=True, order=(F.desc("verified_count"),))
    return in_one_order(ranked.withColumnRenamed("rank", "pool_rank"))


def in_one_order(pools: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("status") == "active", 0).otherwise(1), F.desc("score"), F.desc("verified_count"), "id")
    return pools.withColumn("position", F.row_number().over(order).cast("long"))


def _kept_tokens(quote: Column) -> Column:
    """The index tokens of a quote that any text which contains it has as tokens too: those at its ends may be parts of longer ones there."""
    own, folded = tokens(quote), fold(quote)
    lead, tail = (F.when(folded.rlike(p), 1).otherwise(0) for p in (f"^{TOKEN}", f"{TOKEN}$"))
    return F.slice(own, lead + 1, F.greatest(F.size(own) - lead - tail, F.lit(0)))


def containing(quotes: DataFrame, texts: DataFrame, idx: Index, holds: Column | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """(query_id, id): which texts (id, ...) contain which quotes (query_id, quote, ...), as characters; ``idx`` is an index of at least those texts.

    Candidates are the postings of a quote's rarest token that is whole in it. A quote without one is part of one or two tokens: then the terms that contain its longest piece are found by
    their grams, and their postings are the candidates. Candidates are verified (``holds``, a condition on both sides' columns). A quote of a token that no record has is nowhere. Quotes
    without any letter or digit are looked for in all texts, in blocks of bounded size; so are those with a candidate in SHARE records or less, where all candidates are too many to be broadcast:
    their postings and the texts would be exchanged to try about as many pairs. ``told``: more columns of verified pairs, from both sides' columns.
    """
    holds = F.contains(F.col("text"), F.col("quote")) if holds is None else holds
    told = told or {}
    asked = staged(quotes.where("quote <> ''").withColumns({"__kept": _kept_tokens(F.col("quote")), "__all": tokens(F.col("quote"))}), "quotes")
    kept = asked.select("query_id", F.explode("__kept").alias("term")).distinct()
    whole = kept.join(idx.known(kept.select("term").distinct())[0], "term", "left")
    rarest = whole.groupBy("query_id").agg(F.bool_and(F.col("df").isNotNull()).alias("known"), F.min_by(F.struct("term", "df"), F.struct("df", "term")).alias("r"))
    wanted = rarest.where("known").select("query_id", "r.term", "r.df")
    parts = asked.where((F.size("__kept") == 0) & (F.size("__all") > 0))
    if not parts.isEmpty():
        wanted = wanted.unionByName(_terms_with(parts.select("query_id", F.array_max(F.transform("__all", lambda t: F.struct(F.char_length(t), t.alias("piece"))))["piece"].alias("piece")), idx))
    wanted = staged(wanted.distinct(), "wanted")
    weights = wanted.groupBy("query_id").agg(F.sum("df").alias("n"))
    bare = asked.where(F.size("__all") == 0)
    if (weights.agg(F.sum("n").alias("n")).head().n or 0) > FEW:
        heavy = staged(weights.where(F.col("n") * SHARE >= idx.n_docs).select("query_id"), "heavy")
        bare = bare.unionByName(asked.where(F.size("__all") > 0).join(heavy, "query_id", "left_semi"))
        wanted = wanted.join(heavy, "query_id", "left_anti")
    near = staged(idx.having(wanted, wanted.count()).select("query_id", "id").distinct(), "near")
    clean = asked.drop("__kept", "__all")
    # candidates go to the texts where they are few; texts are exchanged only where they are not
    out = ["query_id", "id", *(c.alias(n) for n, c in told.items())]
    found = texts.join(if_few(near, near.count()), "id").join(clean, "query_id").where(holds).select(*out)
    if not bare.isEmpty():
        met = [texts.join(b, holds) for b in broadcast_blocks(bare.drop("__kept", "__all"), "query_id")]
        found = found.unionByName(union_all(met).select(*out))
    return found


def _terms_with(pieces: DataFrame, idx: Index) -> DataFrame:
    """(query_id, term, df): the index's terms that contain a piece (query_id, piece), by a gram that they share."""
    out = []
    for n in (1, 2, 3):
        own = pieces.where(F.char_length("piece") == n if n < 3 else F.char_length("piece") >= n)
        if own.isEmpty():
            continue
        grams_of = idx.frequencies.select("term", "df", F.explode(F.array_distinct(grams(F.col("term"), n))).alias("gram"))
        met = own.withColumn("gram", F.substring("piece", 1, n)).join(grams_of, "gram").where(F.contains(F.col("term"), F.col("piece")))
        out.append(met.select("query_id", "term", "df"))
    return union_all(out)


def like_fallback(requests: DataFrame, records: DataFrame, direct: DataFrame, limit: int, idx: Index) -> DataFrame:
    """For requests without any direct hit: records that contain the whole query, without wildcards, in any case; ``idx`` has their titles and contents."""
    waiting = requests.join(direct.select("query_id").distinct(), "query_id", "left_anti")
    asked = waiting.select("query_id", F.lower("query").alias("quote"), F.col("project_key").alias("for_project"))
    seen = (F.col("scope") == "user") | (F.col("project_key") == F.col("for_project"))
    holds = F.contains(F.lower("title"), F.col("quote")) | F.contains(F.lower("content"), F.col("quote"))
    met = containing(asked, records.select("id", "title", "content", "scope", "project_key"), idx, seen & holds).join(records.select("id", "status", "verified_count"), "id")
    by = Window.partitionBy("query_id").orderBy(F.when(F.col("status") == "archived", 2).when(F.col("status") == "stale", 1).otherwise(0), F.desc("verified_count"), "id")
    return met.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= limit).select("query_id", "id", "rank")


def anchors(terms: DataFrame, frequencies: DataFrame, max_df: int = 6, keep: int = 3) -> DataFrame:
    """A query's rarest terms: by document frequency, then longer first, then by name."""
    met = terms.where(F.char_length("term") >= 2).join(frequencies.where(F.col("df").between(1, max_df)), "term")
    by = Window.partitionBy("query_id").orderBy("df", F.desc(F.char_length("term")), "term")
    return met.withColumn("position", F.row_number().over(by).cast("long")).where(F.col("position") <= keep).select("query_id", "term", "df", "position")


def pinned(pool: DataFrame, holds: DataFrame) -> DataFrame:
    """A pool with the records that hold a query's rarest identifier first, by state and reviews; the former order decides ties and all the rest."""
    met = pool.join(holds.select("query_id", "id", F.lit(1).alias("pin")), ["query_id", "id"], "left").fillna(0, ["pin"])
    held = F.col("pin") == 1
    state = F.when(held, F.when(F.col("status") == "archived", 2).when(F.col("status") == "stale", 1).otherwise(0)).otherwise(0)
    by = Window.partitionBy("query_id").orderBy(F.desc("pin"), state, F.when(held, -F.col("verified_count")).otherwise(0), "position")
    return met.withColumn("pinned_position", F.row_number().over(by).cast("long"))


def phrases(index: Index, terms: DataFrame) -> Index:
    """An index that also knows the phrases among ``terms``: index tokens in a row, parted by spaces. It needs places.

    Postings of a phrase's tokens are joined by record and place, one token after the other, for the phrases asked for only.
    """
    asked = terms.select(F.col("term").alias("phrase"), F.split("term", " ").alias("t")).where(F.size("t") > 1).distinct()
    asked = staged(asked, "phrases")
    longest = asked.agg(F.max(F.size("t")).alias("n")).head().n
    if longest is None:
        return index
    parts = staged(index.of(asked.select(F.explode("t").alias("term")).distinct()).select("id", "term", "doc_len", F.explode("places").alias("place")), "places")
    met = parts.join(asked.withColumn("term", F.element_at("t", 1)), "term").select("phrase", "t", "id", "doc_len", "place")
    done = []
    for n in range(2, longest + 1):
        step = parts.select("id", F.col("term").alias("next"), (F.col("place") - (n - 1)).cast("int").alias("place"))
        met = met.where(F.size("t") >= n).withColumn("next", F.try_element_at("t", F.lit(n))).join(step, ["id", "place", "next"]).drop("next")
        done.append(met.where(F.size("t") == n).select("phrase", "id", "doc_len"))
    found = staged(union_all(done).groupBy("phrase", "id").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len")), "phrase-postings")
    own = found.select(F.col("phrase").alias("term"), "id", "tf", "doc_len", F.lit(None).cast("array<int>").alias("places"))
    counts = document_frequencies(own)
    return Index(index.postings.unionByName(own), index.frequencies.unionByName(counts), index.n_docs, index.avg_len)
