"""All queries by name over the stand-in relations, and the SQL that states the same."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions import text as tx
from .functions.parsers import holds_literally
from .operators import evaluate, expand, experiences, gates, governance, index, lifecycle, metrics, projections, reports, reuse, search, statements, versions
from .sources import adapters as src
from .plans import relations
from .plans.snapshots import Conflict, Snapshots
from .plans.staging import shared_dir, staged
from .schemas import with_defaults
from .sources.corpora import chunks
from .streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- shared SQL

_IDENTIFIER = "[A-Za-z][A-Za-z0-9]*(?:[-._:][A-Za-z0-9]+)+"
_KR = rf"""kr AS (
  SELECT d.doc_id AS id, regexp_extract(text, '{src.TITLE}') AS title, text AS content, source AS project_key, lang AS source_agent,
         lower(array_to_string(regexp_extract_all(text, '{_IDENTIFIER}'), ' ')) AS search_terms,
         CASE WHEN d.doc_id % 10 = 0 THEN 'user' ELSE 'project' END AS scope,
         CASE d.doc_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'procedure' ELSE 'decision' END AS knowledge_type,
         CASE WHEN quality IS NULL THEN 'candidate' WHEN toxic = 1 THEN 'quarantined' WHEN quality = 0 THEN 'archived'
              WHEN d.doc_id % 7 = 0 THEN 'stale' ELSE 'active' END AS status,
         CAST(coalesce(quality, 0) AS BIGINT) AS verified_count, CAST(coalesce(toxic, 0) AS BIGINT) AS rejected_count,
         d.doc_id % 7 AS hit_count, d.doc_id % 3 AS adopted_count,
         TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id * 137 % 2880 AS INTEGER)) AS created_at,
         TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id * 137 % 2880 + d.doc_id % 50 AS INTEGER)) AS updated_at
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
_EV = """ev AS (
  SELECT doc_id AS knowledge_id, outcome,
         CASE doc_id % 3 WHEN 0 THEN 'user_approval' WHEN 1 THEN 'test' ELSE 'observation' END AS evidence_kind,
         'agent' || (doc_id % 5) AS agent_id,
         TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id * 137 % 2880 + CASE outcome WHEN 'verified' THEN 24 ELSE 48 END AS INTEGER)) AS created_at
  FROM (SELECT doc_id, 'verified' AS outcome FROM labels WHERE quality = 1
        UNION ALL SELECT doc_id, 'rejected' FROM labels WHERE toxic = 1))"""
_FOLD = "translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy')"
_TOKENS = "regexp_extract_all(" + _FOLD + r", '[\p{{L}}\p{{N}}]+')"
_SCORED = f"""q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE length(text) <= {src.MAX_QUERY}),
toks AS (SELECT id, {_TOKENS.format("title || ' ' || content")} AS t FROM kr),
stats AS (SELECT count(*)::DOUBLE AS n_docs, avg(len(t)) AS avg_len FROM toks),
post AS (SELECT id, term, count(*) AS tf, any_value(doc_len) AS doc_len
         FROM (SELECT id, len(t) AS doc_len, unnest(t) AS term FROM toks) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt0 AS (SELECT query_id, term, min(p) AS p FROM (
          SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS p FROM (SELECT query_id, {_TOKENS.format('query')} AS t FROM q)) GROUP BY ALL),
qt AS (SELECT query_id, term FROM qt0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p) <= 64),
scored AS (SELECT query_id, id, round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6)
             * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))), 6) AS score
           FROM qt JOIN post USING (term) JOIN dfs USING (term), stats GROUP BY query_id, id),
scoped AS (SELECT s.*, status, verified_count FROM scored s JOIN kr USING (id)
           WHERE status IN ('active', 'stale') AND (scope = 'user' OR project_key = 'src0'))"""
_BM25 = f"{_KR}, {_SCORED}"
_AE = """ae AS (
  SELECT event_id AS id, ts AS created_at, user_id AS session_id, event_type,
         CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN true END AS success, value, props AS payload,
         'agent' || (user_id % 4) AS agent_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
_RE = f"""{_AE}, re AS (
  SELECT id, agent_id, session_id, created_at, value AS latency_ms, k % 2 = 0 AS hit,
         CASE WHEN id % 3 = 0 THEN k % 2 = 0 END AS successful_validation FROM ae WHERE event_type = 'view')"""
_RUNS = """runs AS (
  SELECT o_orderkey AS run_id, 'agent' || (o_custkey % 7) AS agent_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
         o_totalprice AS latency_ms, o_orderdate AS created_at, o_orderkey % 4 AS proposal_count,
         CASE o_orderstatus WHEN 'F' THEN o_orderkey % 3 ELSE 0 END AS promoted_count, o_orderpriority AS proposal_outcome FROM orders)"""
_LINKS = """links AS (
  SELECT l_orderkey AS run_id, l_partkey AS knowledge_id, CASE l_returnflag WHEN 'R' THEN 'deduplicated' ELSE 'produced' END AS relation,
         l_suppkey AS agent_key FROM lineitem)"""
_GOLD = """gold AS (SELECT item_id AS query_id, doc_id AS id FROM documents d, benchmark b WHERE b.text <> '' AND contains(d.text, b.text))"""


def query(sql: str = "") -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def epoch(column: str, name: str | None = None):
    return F.unix_timestamp(column).alias(name or column)


# ---------------------------------------------------------------- retrieval


_SERVING, _RETIRED = ("active", "stale"), ("active", "stale", "archived")


_OPEN: dict[tuple[str, str], index.Index] = {}


def _place(spark: SparkSession, sf_dir: str, how: str) -> str:
    """The folder of what is derived from these files in some way, which is told by text; the numbers of lambda variables are not a part of it."""
    told = hashlib.sha256(re.sub(r"\b([xyz])_\d+", r"\1", how).encode()).hexdigest()
    return f"{shared_dir(spark)}/tidemark/indexes/{src.snapshot_name(spark, sf_dir, 'documents', 'labels')}-{told[:16]}"


def _spread(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores, dealt out: reading texts takes long, and a file of one row group is one task."""
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores, "id") if len(rows.inputFiles()) < cores else rows


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records with the features that gates read, and the graph of their terms: made for these files once, like their index."""
    kr = _spread(spark, with_defaults(src.knowledge_records(spark, sf_dir).withColumn("source_session", F.col("project_key"))))
    own = search.prepared(kr)
    at = _place(spark, sf_dir, f"{src.TITLE} {own._jdf.queryExecution().analyzed().schema().treeString()} {search.FEATURES}")
    store = Snapshots(spark, at)
    if 1 not in store.versions():
        try:
            # the graph reads titles and search terms where they have been written: texts are read once
            store.commit({"records": own, "edges": lambda made: search.term_graph(made["records"])}, 0)
        except Conflict:
            pass  # another session was first with the same
    return store.read("records", 1), store.read("edges", 1)


def _stored(spark: SparkSession, sf_dir: str, text: Column, places: bool = False) -> index.Index:
    """The stored index of the records' ``text``: built for these files once, then opened by every session, and kept open by this one.

    It is found by the files, by the layout of indexes and by how texts are read, so that none that was built otherwise is opened.
    """
    at = _place(spark, sf_dir, f"{index.LAYOUT} {src.TITLE} {text} {tx.tokens(F.col('text'))}")
    if (key := (spark.sparkContext.applicationId, at)) not in _OPEN:
        _OPEN[key] = index.stored(spark, at, 1, with_defaults(src.record_texts(spark, sf_dir)), text=text, places=places)
    return _OPEN[key]


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    return _stored(spark, sf_dir, F.concat_ws(" ", "title", "content"))


def _quoting(spark: SparkSession, sf_dir: str, *quote: Column, told: dict[str, Column] | None = None) -> DataFrame:
    """(query_id, id, ``told``): the documents that hold what ``quote`` takes of a passage; more columns of it are for ``told`` to read."""
    passages = src.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), *quote)
    docs = src.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return index.containing(passages, docs, _index(spark, sf_dir), told=told)


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id): the documents that quote a passage; found once, as reports read them several times."""
    return staged(_quoting(spark, sf_dir, F.col("text").alias("quote")), "gold")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, index.Index]:
    """(query terms, requests, index)"""
    q = src.search_requests(spark, sf_dir)
    return index.query_terms(q), q, _index(spark, sf_dir)


def _best(spark: SparkSession, sf_dir: str, k: int, statuses: tuple[str, ...] = ()) -> DataFrame:
    """The k best records of each query: of all records, or of those in the given states that its project may see."""
    terms, q, idx = _asked(spark, sf_dir)
    return index.best(terms, idx, k, q, src.knowledge_records(spark, sf_dir) if statuses else None, statuses)


@query(f"WITH {_BM25} SELECT n_docs, round(avg_len, 6) AS avg_len, (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM dfs) AS terms FROM stats")
def index_numbers(spark, sf_dir):
    """What the index holds. The first query that asks for it builds it."""
    idx = _index(spark, sf_dir)
    terms = idx.frequencies.agg(F.sum("df").cast("long").alias("postings"), F.count("*").alias("terms"))
    return terms.select(F.lit(idx.n_docs).alias("n_docs"), F.round(F.lit(idx.avg_len), 6).alias("avg_len"), "postings", "terms")


@query(f"WITH {_BM25} SELECT query_id, id, score, row_number() OVER w AS rank FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id) QUALIFY rank <= 3")
def search_naive_bm25_top3(spark, sf_dir):
    return _best(spark, sf_dir, 3)


@query(f"WITH {_BM25} SELECT query_id, id, score, row_number() OVER w AS rank FROM scoped WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id) QUALIFY rank <= 3")
def search_scoped_bm25(spark, sf_dir):
    return _best(spark, sf_dir, 3, _SERVING).select("query_id", "id", "score", "rank")


_POOL = """pool AS (SELECT query_id, id, status, score, verified_count, row_number() OVER (PARTITION BY query_id, status
             ORDER BY score DESC, verified_count DESC, id) AS pool_rank FROM scoped QUALIFY pool_rank <= 24),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE status WHEN 'active' THEN 0 ELSE 1 END, score DESC,
             verified_count DESC, id) AS position FROM pool)"""


@query(f"WITH {_BM25}, {_POOL} SELECT query_id, id, status, score, pool_rank, position FROM placed")
def search_pool_by_status(spark, sf_dir):
    terms, q, idx = _asked(spark, sf_dir)
    return index.status_pools(terms, idx, 3, q, src.knowledge_records(spark, sf_dir)).select("query_id", "id", "status", "score", "pool_rank", "position")


_FRAGMENT = r"\p{L}(\p{L}{4,})\p{L}"


@query(rf"""WITH {_KR}, w0 AS (SELECT item_id AS query_id, regexp_extract(text, '{_FRAGMENT}', 1) AS query FROM benchmark WHERE length(text) <= {src.MAX_QUERY}),
seen AS (SELECT * FROM kr WHERE status IN ('active', 'stale') AND (scope = 'user' OR project_key = 'src0')),
known AS (SELECT DISTINCT unnest({_TOKENS.format("title || ' ' || content")}) AS term FROM seen),
w AS (SELECT w0.* FROM w0 WHERE query <> '' AND NOT EXISTS (SELECT 1 FROM known WHERE term = {_FOLD.format('query')}))
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE status WHEN 'stale' THEN 1 ELSE 0 END, verified_count DESC, id) AS rank
FROM w, seen WHERE contains(lower(title), lower(query)) OR contains(lower(content), lower(query))
QUALIFY rank <= 5""")
def search_like_fallback(spark, sf_dir):
    # requests are the inside of a word, which the index seldom has as a term
    q = src.search_requests(spark, sf_dir).withColumn("query", F.regexp_extract("query", _FRAGMENT, 1)).where("query <> ''")
    kr = src.knowledge_records(spark, sf_dir)
    direct = index.best(index.query_terms(q), _index(spark, sf_dir), 1, q, kr, _SERVING)
    return index.like_fallback(q, kr.where(F.col("status").isin(*_SERVING)), direct, 5, _index(spark, sf_dir))


@query(f"WITH {_BM25} SELECT DISTINCT term, least(coalesce(df, 0), 7)::BIGINT AS df FROM qt LEFT JOIN dfs USING (term)")
def df_bounded(spark, sf_dir):
    terms, _, idx = _asked(spark, sf_dir)
    return idx.frequencies_of(terms, 6)


_ANCHORS = """anch AS (SELECT query_id, term, df, row_number() OVER (PARTITION BY query_id ORDER BY df, length(term) DESC, term) AS position
FROM qt JOIN dfs USING (term) WHERE df BETWEEN 1 AND 6 AND length(term) >= 2 QUALIFY position <= 3)"""


@query(f"WITH {_BM25}, {_ANCHORS} SELECT query_id, term, df, position FROM anch")
def anchor_terms(spark, sf_dir):
    terms, _, idx = _asked(spark, sf_dir)
    return index.anchors(terms, idx.frequencies_of(terms, 6))


@query(f"""WITH {_BM25}, {_POOL}, {_ANCHORS}, holds AS (SELECT DISTINCT a.query_id, p.id FROM anch a JOIN post p USING (term) WHERE a.position = 1)
SELECT query_id, id, CASE WHEN h.id IS NULL THEN 0 ELSE 1 END AS pin, row_number() OVER (PARTITION BY query_id
  ORDER BY CASE WHEN h.id IS NULL THEN 0 ELSE 1 END DESC, CASE WHEN h.id IS NOT NULL AND status = 'stale' THEN 1 ELSE 0 END,
           CASE WHEN h.id IS NULL THEN 0 ELSE verified_count END DESC, position) AS pinned_position
FROM placed LEFT JOIN holds h USING (query_id, id)""")
def pin_discriminative(spark, sf_dir):
    terms, q, idx = _asked(spark, sf_dir)
    rare = index.anchors(terms, idx.frequencies_of(terms, 6)).where("position = 1")
    holds = idx.of(rare.select("query_id", "term")).select("query_id", "id").distinct()
    pool = index.status_pools(terms, idx, 3, q, src.knowledge_records(spark, sf_dir))
    return index.pinned(pool, holds).select("query_id", "id", "pin", "pinned_position")


def _title_terms(spark, sf_dir):
    kr = src.knowledge_records(spark, sf_dir)
    return kr.select("id", "project_key", "verified_count", "created_at", "status", F.explode(F.array_distinct(tx.tokens(F.concat_ws(" ", "title", "search_terms")))).alias("term")).where(F.char_length("term") >= 4)


_TT = f"""{_KR}, tt AS (SELECT DISTINCT id, project_key, verified_count, created_at, status, term FROM (
  SELECT id, project_key, verified_count, created_at, status, unnest({_TOKENS.format("concat_ws(' ', title, search_terms)")}) AS term FROM kr) WHERE length(term) >= 4)"""
_EDGES = f"""{_TT}, rar AS (SELECT project_key, term, count(DISTINCT id) AS df FROM tt GROUP BY ALL),
own AS (SELECT id, project_key, created_at, term FROM tt JOIN rar USING (project_key, term)
        QUALIFY row_number() OVER (PARTITION BY project_key, id ORDER BY df, term) <= 24),
edges AS (SELECT x.project_key, x.term AS a, y.term AS b, count(*) AS n, max(x.created_at) AS last_seen
          FROM own x JOIN own y ON x.id = y.id AND x.project_key = y.project_key AND x.term < y.term GROUP BY ALL)"""


@query(f"WITH {_EDGES} SELECT project_key, a, b, n, epoch(last_seen)::BIGINT AS last_seen FROM edges")
def cooccurrence_edges(spark, sf_dir):
    return expand.cooccurrence(_title_terms(spark, sf_dir)).withColumn("last_seen", F.unix_timestamp("last_seen"))


_QP = """qp AS (SELECT DISTINCT query_id, 'src' || (query_id % 20) AS project_key, term FROM qt)"""


@query(f"""WITH {_EDGES}, {_SCORED}, {_QP},
ties AS (SELECT project_key, a AS term, b AS other, n FROM edges WHERE n >= 2 UNION ALL SELECT project_key, b, a, n FROM edges WHERE n >= 2),
met AS (SELECT query_id, other AS term, max(n) AS strength FROM qp JOIN ties USING (project_key, term) GROUP BY ALL)
SELECT query_id, term, strength, row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, term) AS position
FROM met ANTI JOIN qp USING (query_id, term) QUALIFY position <= 3""")
def bridge_terms(spark, sf_dir):
    q = src.search_requests(spark, sf_dir)
    wanted = index.query_terms(q).withColumn("project_key", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return expand.bridges(wanted, expand.cooccurrence(_title_terms(spark, sf_dir)))


@query(f"""WITH {_TT}, newest AS (SELECT id FROM kr WHERE status IN ('active', 'stale')
   QUALIFY row_number() OVER (PARTITION BY project_key ORDER BY created_at DESC, id DESC) <= 400),
pt AS (SELECT project_key, id, term, verified_count FROM tt SEMI JOIN newest USING (id)),
seeds AS (SELECT id AS query_id, project_key, id FROM kr WHERE status = 'active'),
df AS (SELECT project_key, term, count(*) AS df FROM pt GROUP BY ALL),
topic AS (SELECT DISTINCT query_id, project_key, term FROM seeds JOIN pt USING (project_key, id)),
sc AS (SELECT query_id, pt.id, verified_count, round(sum(1.0::DOUBLE / df), 6) AS weight, count(*) AS shared
       FROM topic JOIN pt USING (project_key, term) JOIN df USING (project_key, term) WHERE query_id <> pt.id GROUP BY ALL)
SELECT query_id, id, verified_count, weight, shared,
       row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, shared DESC, verified_count DESC, id) AS rank
FROM sc WHERE shared >= 2 QUALIFY rank <= 3""")
def sibling_candidates(spark, sf_dir):
    kr = src.knowledge_records(spark, sf_dir)
    pool = expand.newest(kr.where("status in ('active', 'stale')")).select("id")
    terms = _title_terms(spark, sf_dir).join(pool, "id", "left_semi").select("project_key", "id", "term", "verified_count")
    seeds = kr.where("status = 'active'").select(F.col("id").alias("query_id"), "project_key", "id")
    return expand.siblings(seeds, terms)


@query(f"""WITH {_BM25}, retired AS (SELECT s.*, status FROM scored s JOIN kr USING (id) WHERE status IN ('active', 'stale', 'archived') AND (scope = 'user' OR project_key = 'src0')),
top8 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM retired QUALIFY rank <= 8)
SELECT query_id, id, score, rank FROM top8 WHERE status = 'archived'""")
def shadow_probe(spark, sf_dir):
    return _best(spark, sf_dir, 8, _RETIRED).where("status = 'archived'").select("query_id", "id", "score", "rank")


@query(f"""WITH {_BM25}, retired AS (SELECT s.*, status FROM scored s JOIN kr USING (id) WHERE status IN ('active', 'stale', 'archived') AND (scope = 'user' OR project_key = 'src0')),
top8 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM retired QUALIFY rank <= 8),
a AS (SELECT count(DISTINCT query_id) AS probed, count(DISTINCT query_id) FILTER (status = 'archived') AS missed FROM top8),
b AS (SELECT count(DISTINCT kr.id) AS archived, count(DISTINCT h.id) AS false_kills
      FROM kr LEFT JOIN (SELECT DISTINCT id FROM top8 WHERE status = 'archived') h ON h.id = kr.id WHERE kr.status = 'archived')
SELECT probed, missed, archived, false_kills, round(missed::DOUBLE / nullif(probed, 0), 6) AS miss_rate,
       round(false_kills::DOUBLE / nullif(archived, 0), 6) AS false_kill_rate FROM a, b""")
def lfhv_report(spark, sf_dir):
    probes = _best(spark, sf_dir, 8, _RETIRED)
    return metrics.lfhv_report(probes.withColumn("retired_hit", F.col("status") == "archived"), src.knowledge_records(spark, sf_dir))


# ---------------------------------------------------------------- publication and lifecycle


_HASHED = f"""{_KR}, hashed AS (SELECT *, sha256(project_key || chr(31) || scope || chr(31) || knowledge_type || chr(31) || title || chr(31) || content) AS content_hash FROM kr),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY created_at, id) AS n,
                  first_value(id) OVER (PARTITION BY content_hash ORDER BY created_at, id) AS knowledge_id FROM hashed)"""


@query(f"WITH {_HASHED} SELECT id, content_hash FROM ranked WHERE n = 1")
def publish_dedup(spark, sf_dir):
    return lifecycle.publish(src.knowledge_records(spark, sf_dir))[0].select("id", "content_hash")


@query(f"WITH {_HASHED} SELECT content_hash, id AS request_id, source_agent, 'confirmed_duplicate' AS outcome, knowledge_id FROM ranked WHERE n > 1")
def duplicate_evidence(spark, sf_dir):
    # two projects, so that the stand-in corpus has equal requests in one
    return lifecycle.publish(src.knowledge_records(spark, sf_dir))[1]


@query(f"""WITH {_KR}, o AS (SELECT scope, knowledge_type, source_agent, content, arg_min(id, (created_at, id)) AS knowledge_id FROM kr
WHERE status = 'candidate' GROUP BY ALL) SELECT id AS request_id, knowledge_id FROM kr JOIN o USING (scope, knowledge_type, source_agent, content) WHERE id <> knowledge_id""")
def candidate_body_dedup(spark, sf_dir):
    one = src.knowledge_records(spark, sf_dir).withColumn("project_key", F.lit("all"))
    return lifecycle.body_duplicates(one, one)


@query(f"""WITH {_KR}, s AS (SELECT scope, content, min(id) AS target_id FROM kr WHERE status IN ('active', 'stale') GROUP BY ALL)
SELECT id AS candidate_id, target_id FROM kr JOIN s USING (scope, content) WHERE status = 'candidate'""")
def merge_plan(spark, sf_dir):
    kr = src.knowledge_records(spark, sf_dir).withColumns({"project_key": F.lit("all"), "knowledge_type": F.lit("fact")})
    return lifecycle.merge_plan(kr)


@query(f"""WITH {_KR}, f AS (SELECT *, count(*) OVER () AS total FROM kr
WHERE scope = 'project' AND project_key = 'src3' AND status = 'active' AND updated_at >= TIMESTAMP '2024-01-05' AND updated_at <= TIMESTAMP '2024-04-20 23:59:59.999999'
  AND (contains(lower(title), 'th') OR contains(lower(content), 'th') OR contains(lower(search_terms), 'th') OR contains(lower(source_agent), 'th') OR contains(lower(project_key), 'th')))
SELECT id, status, knowledge_type, epoch(updated_at)::BIGINT AS updated_at, total FROM f ORDER BY updated_at DESC, id LIMIT 100 OFFSET 1""")
def list_records_filtered(spark, sf_dir):
    kr = src.knowledge_records(spark, sf_dir)
    page, total = lifecycle.list_records(kr, "src3", status="active", scope="project", query="Th", updated_from="2024-01-05", updated_to="2024-04-20", limit=100, offset=1)
    return page.select("id", "status", "knowledge_type", epoch("updated_at")).crossJoin(total)


@query(f"""WITH {_KR}, f AS (SELECT *, count(*) OVER () AS total FROM kr WHERE (scope = 'user' OR project_key = 'src1') AND knowledge_type = 'fact' AND source_agent = 'en')
SELECT id, total FROM f ORDER BY updated_at DESC, id LIMIT 50""")
def list_records_visible(spark, sf_dir):
    page, total = lifecycle.list_records(src.knowledge_records(spark, sf_dir), "src1", knowledge_type="fact", source_agent="en", limit=50)
    return page.select("id").crossJoin(total)


@query(f"WITH {_KR} SELECT id, project_key, row_number() OVER (PARTITION BY project_key ORDER BY created_at, id) AS n FROM kr WHERE status = 'candidate' QUALIFY n <= 20")
def review_queue(spark, sf_dir):
    kr = src.knowledge_records(spark, sf_dir).where("status = 'candidate'")
    return lifecycle.prune(kr, ["project_key"], ["created_at", "id"], 20).select("id", "project_key", "n")


@query(f"""WITH {_KR} SELECT project_key, count(*) AS available, count(*) FILTER (verified_count > 0) AS confirmed,
count(*) FILTER (status IN ('active', 'stale')) AS retrievable, count(*) FILTER (status IN ('active', 'stale') AND scope = 'user') AS shared,
count(DISTINCT source_agent) AS source_agents FROM kr GROUP BY 1""")
def overview_summary(spark, sf_dir):
    return metrics.overview(src.knowledge_records(spark, sf_dir))


@query(f"WITH {_KR} SELECT project_key, count(*) AS n, epoch(max(updated_at))::BIGINT AS last_updated FROM kr GROUP BY 1 ORDER BY last_updated DESC, project_key")
def project_list(spark, sf_dir):
    return metrics.projects(src.knowledge_records(spark, sf_dir)).withColumn("last_updated", F.unix_timestamp("last_updated"))


@query(f"WITH {_KR} SELECT status, count(*) AS n, sum(verified_count)::BIGINT AS verified, sum(rejected_count)::BIGINT AS rejected FROM kr GROUP BY 1")
def status_counts(spark, sf_dir):
    return metrics.status_counts(src.knowledge_records(spark, sf_dir))


@query(f"WITH {_KR} SELECT id, round(coalesce(verified_count::DOUBLE / nullif(verified_count + rejected_count, 0), 0), 3) AS confidence FROM kr")
def confidence(spark, sf_dir):
    return src.knowledge_records(spark, sf_dir).select("id", lifecycle.confidence(F.col("verified_count"), F.col("rejected_count")).alias("confidence"))


_LAST = f"""{_KR}, {_EV}, lc AS (SELECT kr.*, (SELECT max(created_at) FROM ev WHERE knowledge_id = kr.id AND outcome IN ('used', 'verified')) AS last_confirmed_at FROM kr)"""


@query(f"WITH {_LAST} SELECT id, epoch(last_confirmed_at)::BIGINT AS last_confirmed_at FROM lc")
def last_confirmed(spark, sf_dir):
    return lifecycle.last_confirmed(src.knowledge_records(spark, sf_dir), src.evidence(spark, sf_dir)).select("id", epoch("last_confirmed_at"))


@query(f"""WITH {_LAST}, aged AS (SELECT *, (epoch_us(TIMESTAMP '{src.AS_OF}') - epoch_us(greatest(created_at, last_confirmed_at))) / 86400e6::DOUBLE AS days FROM lc),
w AS (SELECT id, row_number() OVER (PARTITION BY project_key ORDER BY verified_count, hit_count, adopted_count, updated_at, id) AS weakness,
             count(*) OVER (PARTITION BY project_key) AS n_active FROM kr WHERE status = 'active'),
p AS (SELECT a.*, coalesce(weakness <= greatest(0, least(n_active - 12, n_active - 5)), false) AS over,
        CASE WHEN status IN ('active', 'stale') AND days >= 90 THEN 'archived' WHEN status = 'active' AND days >= 30 THEN 'stale'
             WHEN status = 'active' AND over THEN 'stale' WHEN status = 'candidate' AND created_at + INTERVAL 1 DAY <= TIMESTAMP '{src.AS_OF}' THEN 'quarantined' END AS to_status
      FROM aged a LEFT JOIN w USING (id))
SELECT id, project_key, status AS from_status, to_status, CASE WHEN status = 'candidate' THEN 'review_deadline' WHEN days >= 90 THEN 'idle_archive'
  WHEN days >= 30 THEN 'idle_stale' ELSE 'capacity' END AS reason FROM p WHERE to_status IS NOT NULL""")
def sweep_plan(spark, sf_dir):
    kr = lifecycle.last_confirmed(src.knowledge_records(spark, sf_dir), src.evidence(spark, sf_dir))
    return lifecycle.sweep_plan(kr, src.AS_OF, capacity=12, floor=5)


@query(f"""WITH {_KR}, w AS (SELECT id, project_key, row_number() OVER (PARTITION BY project_key ORDER BY verified_count, hit_count, adopted_count, updated_at, id) AS weakness,
count(*) OVER (PARTITION BY project_key) AS n_active FROM kr WHERE status = 'active') SELECT * FROM w WHERE weakness <= least(n_active - 12, n_active - 5)""")
def capacity_evictions(spark, sf_dir):
    return lifecycle.evictions(src.knowledge_records(spark, sf_dir), 12, 5).select("id", "project_key", "weakness", "n_active")


@query(f"WITH {_KR} SELECT id FROM kr WHERE status = 'candidate' AND created_at + INTERVAL 1 DAY <= TIMESTAMP '{src.AS_OF}'")
def candidate_expiry(spark, sf_dir):
    return lifecycle.expired(src.knowledge_records(spark, sf_dir), src.AS_OF).select("id")


@query(f"WITH {_AE} SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS n FROM ae QUALIFY n <= 50")
def audit_prune(spark, sf_dir):
    return lifecycle.prune(src.agent_events(spark, sf_dir), ["session_id"], [F.desc("created_at"), F.desc("id")]).select("id", "session_id", "n")


@query(f"""WITH {_KR}, r AS (SELECT id + CASE WHEN id % 50 = 0 THEN 10000000 ELSE 0 END AS id, CASE WHEN id % 3 = 0 THEN 'active' ELSE status END AS expected_status,
'archived' AS to_status FROM kr) SELECT r.id, expected_status, to_status, coalesce(k.status = expected_status, false) AS applied,
CASE WHEN k.status IS NULL THEN 'missing' WHEN k.status <> expected_status THEN 'status_changed' END AS conflict FROM r LEFT JOIN kr k ON k.id = r.id""")
def transit_cas(spark, sf_dir):
    kr = src.knowledge_records(spark, sf_dir)
    asked = kr.select(
        (F.col("id") + F.when(F.col("id") % 50 == 0, 10_000_000).otherwise(0)).alias("id"),
        F.when(F.col("id") % 3 == 0, "active").otherwise(F.col("status")).alias("expected_status"),
        F.lit("archived").alias("to_status"),
    )
    return lifecycle.transitions(kr, asked).select("id", "expected_status", "to_status", "applied", "conflict")


@query(f"""WITH {_KR}, {_EV}, c AS (SELECT knowledge_id AS id, count(*) FILTER (outcome IN ('used', 'verified')) AS adopted,
 count(*) FILTER (outcome = 'verified') AS verified, count(*) FILTER (outcome = 'rejected') AS rejected,
 max(CASE WHEN evidence_kind <> 'observation' THEN CASE outcome WHEN 'verified' THEN 1 ELSE 2 END END) AS last_sound, max(evidence_kind) AS kind,
 bool_or(outcome = 'verified') AS has_verified FROM ev GROUP BY 1)
SELECT kr.id, CASE WHEN last_sound = 2 THEN 'quarantined'
   WHEN last_sound = 1 AND (status IN ('candidate', 'active', 'stale') OR kind = 'user_approval') THEN 'active' ELSE status END AS status,
 coalesce(adopted, 0) + adopted_count AS adopted_count, coalesce(verified, 0) + verified_count AS verified_count, coalesce(rejected, 0) + rejected_count AS rejected_count
FROM kr LEFT JOIN c USING (id)""")
def feedback_fold(spark, sf_dir):
    feed = src.evidence(spark, sf_dir).select(
        F.col("knowledge_id").alias("id"), F.unix_timestamp("created_at").alias("seq"), "outcome", "evidence_kind", (F.col("evidence_kind") != "observation").alias("has_ref")
    )
    return lifecycle.feedback(src.knowledge_records(spark, sf_dir), feed).select("id", "status", "adopted_count", "verified_count", "rejected_count")


# ---------------------------------------------------------------- versions


def _claims(spark, sf_dir):
    p = src.catalogue_records(spark, sf_dir)
    return p.select(F.col("knowledge_id").alias("id"), F.concat_ws("|", "slot", F.col("p_size").cast("string")).alias("slot"), "value")


_CLAIMS = "claims AS (SELECT p_partkey AS id, p_brand || '|' || p_size AS slot, p_type AS value FROM part)"


@query(f"""WITH {_CLAIMS}, v AS (SELECT slot, value, min(id) AS id FROM claims GROUP BY ALL)
SELECT a.slot, a.id, a.value, b.id AS peer_id, b.value AS peer_value FROM v a JOIN v b USING (slot) WHERE a.value <> b.value""")
def slot_peers(spark, sf_dir):
    return versions.peers(_claims(spark, sf_dir))


@query(f"WITH {_CLAIMS} SELECT c.id, s.slot, s.id AS standpoint FROM claims c JOIN (SELECT slot, value, min(id) AS id FROM claims GROUP BY ALL) s USING (slot, value)")
def slot_members(spark, sf_dir):
    claims = _claims(spark, sf_dir)
    return claims.join(versions.standpoints(claims).select("slot", "value", F.col("id").alias("standpoint")), ["slot", "value"]).select("id", "slot", "standpoint")


@query(f"WITH {_CLAIMS} SELECT slot, count(DISTINCT value) AS n_values, count(*) AS n_records, count(DISTINCT value) > 1 AS conflicted FROM claims GROUP BY 1")
def slot_conflicts(spark, sf_dir):
    return versions.conflicts(_claims(spark, sf_dir))


_HISTORY = """h AS (SELECT o_custkey AS slot, o_orderkey AS id, o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to,
 lead(o_orderkey) OVER w AS superseded_by, o_orderstatus AS title FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def _history(spark, sf_dir):
    o = src.read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        F.col("o_custkey").alias("slot"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("valid_from"),
        F.lead("o_orderdate").over(w).alias("valid_to"), F.lead("o_orderkey").over(w).alias("superseded_by"), F.col("o_orderstatus").alias("title"),
    )


@query(f"WITH {_HISTORY} SELECT slot, id FROM h WHERE valid_from <= TIMESTAMP '1997-06-01' AND (valid_to IS NULL OR TIMESTAMP '1997-06-01' < valid_to)")
def asof_version(spark, sf_dir):
    moments = src.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slot"), F.lit("1997-06-01").cast("timestamp_ntz").alias("as_of"))
    return versions.valid_at(_history(spark, sf_dir), moments).select("slot", "id")


@query(f"""WITH {_HISTORY}, p AS (SELECT superseded_by AS id, max(id) AS predecessor_id FROM h WHERE superseded_by IS NOT NULL GROUP BY 1)
SELECT h.id, h.superseded_by, s.title AS successor_title, predecessor_id FROM h LEFT JOIN h s ON s.id = h.superseded_by LEFT JOIN p ON p.id = h.id""")
def supersession_links(spark, sf_dir):
    return versions.chain(_history(spark, sf_dir)).select("id", "superseded_by", "successor_title", "predecessor_id")


# ---------------------------------------------------------------- runs, recalls, latency


@query(f"""WITH {_RUNS}, {_LINKS} SELECT l.knowledge_id, r.run_id, r.status, a.s_name AS agent_name, l.relation
FROM links l JOIN runs r USING (run_id) JOIN supplier a ON a.s_suppkey = l.agent_key WHERE r.status = 'completed'""")
def run_provenance(spark, sf_dir):
    made = projections.provenance(src.compilation_links(spark, sf_dir), src.learning_runs(spark, sf_dir), src.agents(spark, sf_dir))
    return made.where("status = 'completed'").select("knowledge_id", "run_id", "status", "agent_name", "relation")


@query(f"""WITH {_RUNS}, {_LINKS} SELECT r.status, count(*) AS members FROM runs r WHERE EXISTS (SELECT 1 FROM links l WHERE l.run_id = r.run_id AND relation = 'produced') GROUP BY 1""")
def run_members_semi(spark, sf_dir):
    own = projections.with_members(src.learning_runs(spark, sf_dir), src.compilation_links(spark, sf_dir))
    return own.groupBy("status").agg(F.count("*").alias("members"))


@query(f"""WITH {_RUNS} SELECT agent_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, sum(proposal_count)::BIGINT AS proposals,
sum(promoted_count)::BIGINT AS promoted, round(avg(latency_ms) FILTER (status = 'completed'), 3) AS avg_latency_ms FROM runs GROUP BY 1""")
def run_metrics(spark, sf_dir):
    return metrics.run_metrics(src.learning_runs(spark, sf_dir), "agent_id")


@query(f"""WITH {_RE} SELECT agent_id, count(*) AS attempts, count(*) FILTER (hit) AS hits, round(coalesce(count(*) FILTER (hit) / count(*)::DOUBLE, 0), 6) AS hit_rate,
count(successful_validation) AS evaluated, count(*) FILTER (successful_validation) AS successes, round(avg(latency_ms), 3) AS avg_latency_ms FROM re GROUP BY 1""")
def recall_metrics(spark, sf_dir):
    return metrics.recall_metrics(src.recall_events(spark, sf_dir), "agent_id")


@query(f"WITH {_RUNS} SELECT agent_id, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, run_id DESC) = 1")
def latest_run_per_agent(spark, sf_dir):
    runs = src.learning_runs(spark, sf_dir).select("agent_id", "run_id", "status", "created_at")
    return metrics.latest(runs, ["agent_id"], F.struct("created_at", "run_id")).select("agent_id", "run_id", "status")


@query(f"WITH {_RE} SELECT agent_id, count(latency_ms) AS samples, round(quantile_disc(latency_ms, 0.5), 3) AS p50, round(quantile_disc(latency_ms, 0.95), 3) AS p95 FROM re GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return metrics.timing_metrics(src.recall_events(spark, sf_dir), "agent_id")


_PAIRS = """s AS (SELECT l_orderkey AS experiment, l_linenumber % 2 AS pair, CASE l_linestatus WHEN 'O' THEN 'on' ELSE 'off' END AS mode, min(l_extendedprice) AS ttft FROM lineitem GROUP BY ALL),
pairs AS (SELECT a.experiment, a.pair, a.ttft - b.ttft AS delta FROM s a JOIN s b USING (experiment, pair) WHERE a.mode = 'on' AND b.mode = 'off')"""


@query(f"""WITH {_PAIRS} SELECT (experiment % 5)::BIGINT AS bucket, count(*) AS pairs, round(quantile_disc(delta, 0.5), 3) AS p50_delta,
round(quantile_disc(delta, 0.95), 3) AS p95_delta, count(*) < 20 AS limited_sample FROM pairs GROUP BY 1""")
def latency_pair_delta(spark, sf_dir):
    pairs = metrics.latency_pairs(src.latency_samples(spark, sf_dir))
    return metrics.latency_deltas(pairs.withColumn("bucket", F.col("experiment") % 5), "bucket")


@query(f"WITH {_AE} SELECT DISTINCT agent_id, session_id, event_type, sha256(payload) AS payload_hash FROM ae")
def event_dedup(spark, sf_dir):
    e = src.agent_events(spark, sf_dir).select("agent_id", "session_id", "event_type", F.sha2("payload", 256).alias("payload_hash"))
    return e.dropDuplicates()


@query(f"""WITH {_AE}, known AS (SELECT session_id, agent_id AS command, success, created_at, id FROM ae WHERE success IS NOT NULL)
SELECT session_id, command, arg_max(success, (created_at, id)) AS passed, count(*) FILTER (NOT success) AS failures,
arg_max(success, (created_at, id)) AND count(*) FILTER (NOT success) > 0 AS recovered FROM known GROUP BY ALL""")
def failure_then_pass(spark, sf_dir):
    return metrics.failure_then_pass(src.agent_events(spark, sf_dir).withColumnRenamed("agent_id", "command"))


_OUT = f"""{_AE}, outc AS (SELECT session_id % 500 AS knowledge_id, count(*) FILTER (success) AS passed, count(*) FILTER (NOT success) AS failed FROM ae WHERE success IS NOT NULL GROUP BY 1)"""


def _outcomes(spark, sf_dir):
    e = src.agent_events(spark, sf_dir).where("success is not null")
    return e.groupBy((F.col("session_id") % 500).alias("knowledge_id")).agg(F.count_if("success").alias("passed"), F.count_if(~F.col("success")).alias("failed"))


@query(f"""WITH {_OUT} SELECT count(DISTINCT p_partkey) AS experiences, coalesce(sum(passed), 0)::BIGINT AS passed, coalesce(sum(failed), 0)::BIGINT AS failed,
count(*) FILTER (failed > 0) AS with_failures FROM part JOIN outc ON knowledge_id = p_partkey""")
def experience_metrics(spark, sf_dir):
    return metrics.experience_metrics(_outcomes(spark, sf_dir), src.catalogue_records(spark, sf_dir))


@query(f"""WITH {_OUT}, rows AS (SELECT knowledge_id % 25 AS query_id, knowledge_id AS id, knowledge_id // 25 + 1 AS position, knowledge_id % 3 AS group_id, passed, failed FROM outc),
r AS (SELECT *, round((passed + 1) / (passed + failed + 2)::DOUBLE, 6) AS laplace FROM rows),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY position) AS slot, row_number() OVER (PARTITION BY query_id, group_id ORDER BY laplace DESC, position) AS place FROM r)
SELECT a.query_id, a.id, a.laplace, b.position AS new_position FROM s a JOIN s b ON a.query_id = b.query_id AND a.group_id = b.group_id AND a.place = b.slot""")
def equivalent_rerank(spark, sf_dir):
    o = _outcomes(spark, sf_dir)
    k = F.col("knowledge_id")
    rows = o.select((k % 25).alias("query_id"), k.alias("id"), (F.floor(k / 25) + 1).alias("position"), (k % 3).alias("group_id"), "passed", "failed")
    return metrics.reranked(rows).select("query_id", "id", "laplace", "new_position")


# ---------------------------------------------------------------- turns, corpora, text


@query("""WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)
SELECT conv_id, g::BIGINT AS turn_group, max(CASE WHEN role = 'user' THEN length(text) END)::BIGINT AS user_chars,
count(*) FILTER (role = 'assistant') AS replies, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS reply_chars FROM t WHERE g > 0 GROUP BY ALL""")
def turn_pairs(spark, sf_dir):
    return projections.turn_groups(src.conversations(spark, sf_dir))


@query(f"WITH {_KR}, n AS (SELECT id, project_key, row_number() OVER (PARTITION BY project_key ORDER BY created_at, id) AS n, count(*) OVER (PARTITION BY project_key) AS total FROM kr) SELECT id, project_key FROM n WHERE n <= total // 2")
def oldest_half_archive(spark, sf_dir):
    return lifecycle.oldest_half(src.knowledge_records(spark, sf_dir)).select("id", "project_key")


@query("""SELECT doc_id AS id, n AS chunk, length(substr(text, n * 8000 + 1, 8000))::BIGINT AS chars, sha256(substr(text, n * 8000 + 1, 8000)) AS digest
FROM (SELECT doc_id, text, unnest(range(greatest(1, (length(text) + 7999) // 8000))) AS n FROM documents)""")
def chunk_8000(spark, sf_dir):
    d = src.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return chunks(d, 8000).select("id", "chunk", F.char_length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


@query(r"""WITH r AS (SELECT doc_id AS id, text, regexp_replace(regexp_replace(regexp_replace(text, '\bsk-[A-Za-z0-9_-]{12,}\b', '[REDACTED]', 'g'),
 '(?i)\b(bearer\s+)[A-Za-z0-9._~-]{12,}', '\1[REDACTED]', 'g'),
 '(?i)(["'']?(?:api[_-]?key|access[_-]?token|authorization|password|secret)["'']?)(\s*[:=]\s*)(?:"[^"\n]*"|''[^''\n]*''|[^\s,;}]+)', '\1\2[REDACTED]', 'g') AS out FROM documents)
SELECT id, text <> out AS changed, length(out)::BIGINT AS chars, sha256(out) AS digest FROM r""")
def redact_scan(spark, sf_dir):
    d = src.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", tx.redact(F.col("text")).alias("out"))
    return d.select("id", (F.col("text") != F.col("out")).alias("changed"), F.char_length("out").cast("long").alias("chars"), F.sha2("out", 256).alias("digest"))


_SAYS = lambda text, pattern: f"regexp_matches({text}, '(?i){pattern}')"


@query(rf"""WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'),
s AS (SELECT *, regexp_replace(t, '{gates.DATA}', ' ', 'g') AS said FROM u),
p AS (SELECT *, CASE WHEN {_SAYS('said', P.PIVOT)} THEN regexp_replace(said, '(?is)^.*((?:{P.PIVOT}))', '\1') ELSE t END AS pivoted FROM s),
f AS (SELECT *, trim(regexp_replace(pivoted, '(?i){P.EXCLUSION}', ' ', 'g')) AS focus FROM p)
SELECT conv_id, turn, {_SAYS('said', P.HISTORICAL)} AS historical, {_SAYS('said', P.MEMORY_DISABLED)} AS memory_disabled,
 {_SAYS('focus', P.EXPLANATION)} AND NOT {_SAYS('focus', P.PERSONAL)} AS general_explanation, {_SAYS('said', P.EXCLUDES_PROJECT_SCOPE)} AS exclude_project_scope,
 {_SAYS('said', P.EXCLUDES_PREFERENCES)} AS exclude_user_preferences, len(regexp_extract_all(said, '(?i){P.EXCLUSION}')) AS n_excluded FROM f""")
def query_intent_flags(spark, sf_dir):
    """The intent of each user turn."""
    said = src.conversations(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", gates.query_intent(F.coalesce("text", F.lit(""))).alias("i"))
    flags = ("historical", "memory_disabled", "general_explanation", "exclude_project_scope", "exclude_user_preferences")
    return said.select("conv_id", "turn", *[F.col(f"i.{f}") for f in flags], F.size("i.excluded").cast("long").alias("n_excluded"))


@query(f"WITH t AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS t FROM documents) SELECT id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM t")
def token_terms(spark, sf_dir):
    d = src.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.tokens(F.col("text")).alias("t"))
    return d.select("id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*(?:[-._:][A-Za-z0-9]+)+')) AS term FROM documents)
SELECT lower(term) AS term, count(DISTINCT id) AS df FROM t GROUP BY 1""")
def identifier_terms(spark, sf_dir):
    d = src.read(spark, sf_dir, "documents").select("doc_id", F.explode(tx.composite_identifiers(F.col("text"))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("df"))


# ---------------------------------------------------------------- evaluation


_RESULTS = f"""{_BM25}, {_GOLD}, top3 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 3),
res AS (SELECT q.query_id, (SELECT count(*) FROM gold g WHERE g.query_id = q.query_id) AS n_gold,
  (SELECT count(*) FROM top3 t JOIN gold g ON g.query_id = t.query_id AND g.id = t.id WHERE t.query_id = q.query_id) AS hits,
  (SELECT min(t.rank) FROM top3 t JOIN gold g ON g.query_id = t.query_id AND g.id = t.id WHERE t.query_id = q.query_id) AS first_hit,
  (SELECT count(*) FROM top3 t WHERE t.query_id = q.query_id) AS n_got FROM q)"""


def _results(spark, sf_dir):
    return evaluate.case_results(src.search_requests(spark, sf_dir).select("query_id"), _best(spark, sf_dir, 3), _gold(spark, sf_dir), 3)


@query(f"""WITH {_RESULTS} SELECT count(*) FILTER (n_gold > 0) AS positives, count(*) FILTER (n_gold = 0) AS negatives,
round(avg(hits / 3.0::DOUBLE) FILTER (n_gold > 0), 6) AS precision_at_k, round(avg(hits / n_gold::DOUBLE) FILTER (n_gold > 0), 6) AS recall_at_k,
round(avg(coalesce(1 / first_hit::DOUBLE, 0)) FILTER (n_gold > 0), 6) AS mrr,
round(count(*) FILTER (n_gold = 0 AND n_got > 0) / nullif(count(*) FILTER (n_gold = 0), 0)::DOUBLE, 6) AS negative_injection FROM res""")
def retrieval_quality(spark, sf_dir):
    return evaluate.retrieval_metrics(_results(spark, sf_dir), 3)


@query(f"""WITH {_RESULTS}, c AS (SELECT *, 'c' || (query_id % 4) AS category FROM res WHERE n_gold > 0)
SELECT coalesce(category, 'all') AS category, count(*) AS cases, round(count(*) FILTER (first_hit = 1) / count(*)::DOUBLE, 6) AS hit_1,
round(count(*) FILTER (hits > 0) / count(*)::DOUBLE, 6) AS hit_k, round(avg(hits / n_gold::DOUBLE), 6) AS mean_recall, round(avg(coalesce(1 / first_hit::DOUBLE, 0)), 6) AS mrr
FROM c GROUP BY GROUPING SETS ((), (category))""")
def locomo_block(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("category", F.concat(F.lit("c"), (F.col("query_id") % 4).cast("string")))
    return evaluate.quality_block(r, 3, "category")


@query("""WITH r AS (SELECT o_custkey AS task_id, o_orderkey % 3 AS repeat, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'auto' ELSE 'baseline' END AS mode,
 max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS success FROM orders GROUP BY ALL),
w AS (SELECT a.success AS a, b.success AS b FROM r a JOIN r b USING (task_id, repeat) WHERE a.mode = 'baseline' AND b.mode = 'auto')
SELECT count(*) AS pairs, round(avg(a), 6) AS baseline_rate, round(avg(b), 6) AS auto_rate, round(avg(b - a), 6) AS delta,
count(*) FILTER (b = 1 AND a = 0) AS helped, count(*) FILTER (b = 0 AND a = 1) AS harmed FROM w""")
def paired_modes(spark, sf_dir):
    o = src.read(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").alias("task_id"), (F.col("o_orderkey") % 3).alias("repeat"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "auto").otherwise("baseline").alias("mode"),
        (F.col("o_orderstatus") == "F").alias("success"),
    )
    return evaluate.paired_modes(rows)


_ARMS = f"""{_BM25}, {_GOLD}, arms AS (
 SELECT 'naive' AS arm, query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored) WHERE r <= 3
 UNION ALL SELECT 'gated', query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scoped) WHERE r <= 3),
j AS (SELECT a.*, g.id IS NOT NULL AS relevant, strlen(content)::BIGINT AS bytes FROM arms a JOIN kr USING (id) LEFT JOIN gold g ON g.query_id = a.query_id AND g.id = a.id)"""


def _arms(spark, sf_dir, gold):
    """(query_id, id, arm, bytes, relevant) of both arms, whose few rows are written once."""
    kr = src.knowledge_records(spark, sf_dir, bytes=F.octet_length("content").cast("long"))
    naive = _best(spark, sf_dir, 3).select(F.lit("naive").alias("arm"), "query_id", "id")
    gated = _best(spark, sf_dir, 3, _SERVING).select(F.lit("gated").alias("arm"), "query_id", "id")
    marked = gold.withColumn("relevant", F.lit(True))
    return staged(naive.unionByName(gated).join(kr.select("id", "bytes"), "id").join(marked, ["query_id", "id"], "left").fillna(False, ["relevant"]), "arms")


@query(f"WITH {_ARMS} SELECT arm, count(*) AS injected, count(*) FILTER (relevant) AS relevant, count(*) FILTER (NOT relevant) AS unnecessary, coalesce(sum(bytes) FILTER (NOT relevant), 0)::BIGINT AS unnecessary_bytes FROM j GROUP BY 1")
def naive_vs_gated(spark, sf_dir):
    return evaluate.naive_vs_gated(_arms(spark, sf_dir, _gold(spark, sf_dir)))


@query(f"""WITH {_ARMS}, n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
c AS (SELECT arm, query_id, count(*) FILTER (relevant) > 0 AS hit, count(*) FILTER (relevant) = any_value(n_gold) AS complete FROM j JOIN n USING (query_id) GROUP BY ALL)
SELECT a.query_id, CASE WHEN b.complete THEN 'helped' ELSE 'harmed' END AS change FROM c a JOIN c b USING (query_id) WHERE a.arm = 'naive' AND b.arm = 'gated' AND a.complete <> b.complete""")
def ablation_arms(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    n = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    by_case = _arms(spark, sf_dir, gold).join(n, "query_id").groupBy("arm", "query_id", "n_gold").agg(F.count_if("relevant").alias("found"))
    return evaluate.arm_changes(by_case.withColumn("complete", F.col("found") == F.col("n_gold")), "naive", "gated")


@query(f"""WITH {_KR}, t AS (SELECT id, knowledge_type, scope, row_number() OVER (PARTITION BY knowledge_type, scope ORDER BY sha256('seed' || id), id) AS turn FROM kr)
SELECT id, knowledge_type, scope, turn FROM t ORDER BY turn, knowledge_type, scope LIMIT 40""")
def stratified_sample(spark, sf_dir):
    kr = src.knowledge_records(spark, sf_dir).select("id", "knowledge_type", "scope")
    return evaluate.stratified_sample(kr, ["knowledge_type", "scope"], "seed", 40).withColumn("turn", F.col("turn").cast("long"))


@query(f"WITH {_RUNS} SELECT proposal_outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM runs)::DOUBLE, 6) AS share FROM runs GROUP BY 1")
def admission_distribution(spark, sf_dir):
    return evaluate.distribution(src.learning_runs(spark, sf_dir), "proposal_outcome")


# ---------------------------------------------------------------- traces


def _traces(spark, sf_dir):
    """Traces made of orders: their lines are the items."""
    i = src.read(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    origin = F.when(line == 2, "sibling").when(line == 3, "bridged").when(line == 4, "anchored").when(line == 5, "lfhv_recovered").when(line == 6, "direct")
    k = F.col("l_partkey") % 5
    check = F.when(k == 0, "constraint_pass").when(k == 1, "constraint_fail").when(k == 2, "unchecked")
    item = F.struct(
        F.col("l_partkey").alias("knowledge_id"), line.alias("rank"), F.concat(F.lit("agent"), (F.col("l_suppkey") % 3).cast("string")).alias("source_agent"), origin.alias("origin"),
        (F.col("l_returnflag") != "N").alias("emitted"), (F.col("l_returnflag") == "A").alias("citation_observed"), (F.col("l_quantity") > 40).alias("source_attribution_observed"),
        check.alias("check_status"),
    )
    items = i.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias("items"))
    ok = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    o = src.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("agent"), (F.col("o_custkey") % 3).cast("string")).alias("agent_id"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("completed_at"), F.col("o_totalprice").alias("retrieval_ms"), ok.alias("task_success"),
    )
    return o.join(items, "id")


@query("SELECT l_orderkey AS id, count(*) AS n_items FROM lineitem GROUP BY 1 HAVING bool_or(l_partkey = 7)")
def trace_item_filter(spark, sf_dir):
    return reuse.holding(_traces(spark, sf_dir), F.lit(7)).select("id", F.size("items").cast("long").alias("n_items"))


_TRACES = """tr AS (SELECT l_orderkey AS id, l_partkey AS k, l_returnflag <> 'N' AS emitted, l_returnflag = 'A' AS cited, l_quantity > 40 AS attributed,
 'agent' || (l_suppkey % 3) AS source, 'agent' || (o_custkey % 3) AS agent, o_orderstatus <> 'O' AS completed, o_totalprice AS ms,
 CASE l_linenumber WHEN 2 THEN 'sibling' WHEN 3 THEN 'bridged' WHEN 4 THEN 'anchored' WHEN 5 THEN 'lfhv_recovered' WHEN 6 THEN 'direct' END AS origin,
 CASE l_partkey % 5 WHEN 0 THEN 'constraint_pass' WHEN 1 THEN 'constraint_fail' WHEN 2 THEN 'unchecked' END AS checked,
 CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS ok FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(f"""WITH {_TRACES}, x AS (SELECT *, coalesce(origin, 'direct') AS way, emitted AND source <> agent AS across FROM tr), m AS (SELECT DISTINCT id, ms FROM x),
q AS (SELECT round(quantile_disc(ms, 0.5), 3) AS p50, round(quantile_disc(ms, 0.95), 3) AS p95 FROM m)
SELECT count(DISTINCT id) AS turns, count(*) AS retrieved, count(*) FILTER (emitted) AS emitted, count(*) FILTER (way = 'direct') AS direct, count(*) FILTER (way = 'sibling') AS inferred,
count(*) FILTER (way = 'bridged') AS bridged, count(*) FILTER (way = 'anchored') AS anchored, count(*) FILTER (way = 'lfhv_recovered') AS recovery_candidates,
count(*) FILTER (way = 'lfhv_recovered' AND emitted) AS recovery_emitted, 0::BIGINT AS recovery_restored, count(*) FILTER (way = 'lfhv_recovered' AND NOT emitted) AS recovery_not_emitted,
count(*) FILTER (emitted AND cited) AS cited, count(DISTINCT id) FILTER (emitted) AS turns_emitted, count(DISTINCT id) FILTER (emitted AND cited) AS turns_cited,
count(DISTINCT id) FILTER (emitted AND attributed) AS turns_attributed, count(DISTINCT id) FILTER (emitted AND (cited OR attributed)) AS turns_shown,
count(DISTINCT id) FILTER (emitted AND ok) AS turns_successful, count(DISTINCT k) FILTER (emitted) AS records_emitted, count(DISTINCT id) FILTER (across) AS cross_agent_turns_emitted,
count(DISTINCT id) FILTER (across AND completed AND cited) AS cross_agent_turns_cited, count(DISTINCT id) FILTER (across AND completed AND attributed) AS cross_agent_turns_attributed,
count(DISTINCT id) FILTER (across AND completed AND (cited OR attributed)) AS cross_agent_turns_shown,
count(*) FILTER (emitted AND checked IN ('constraint_pass', 'constraint_fail')) AS checked, count(*) FILTER (across AND checked IN ('constraint_pass', 'constraint_fail')) AS cross_agent_checked,
count(*) FILTER (emitted AND checked = 'constraint_pass') AS constraint_pass, count(*) FILTER (across AND checked = 'constraint_pass') AS cross_agent_constraint_pass,
any_value(p50) AS retrieval_p50_ms, any_value(p95) AS retrieval_p95_ms FROM x, q""")
def reuse_metrics(spark, sf_dir):
    return metrics.reuse_metrics(_traces(spark, sf_dir))


_PAGE = f"""{_BM25}, page AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM scored QUALIFY position <= 8),
sized AS (SELECT query_id, id, position, length(content)::BIGINT AS chars FROM page JOIN kr USING (id))"""


def _page(spark, sf_dir):
    kr = src.knowledge_records(spark, sf_dir)
    page = _best(spark, sf_dir, 8).select("query_id", "id", F.col("rank").alias("position"))
    return page.join(kr.select("id", F.char_length("content").cast("long").alias("chars")), "id")


@query(f"WITH {_PAGE}, s AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY position)::BIGINT AS used FROM sized) SELECT query_id, id, position, used FROM s WHERE used <= 4000")
def context_pack_prefix(spark, sf_dir):
    return reuse.pack_prefix(_page(spark, sf_dir), 4000).select("query_id", "id", "position", "used")


@query(f"""WITH RECURSIVE {_PAGE}, fold AS (
 SELECT query_id, 0::BIGINT AS position, 0::BIGINT AS used, '' AS ids FROM (SELECT DISTINCT query_id FROM sized)
 UNION ALL SELECT f.query_id, s.position, CASE WHEN f.used + s.chars <= 4000 THEN f.used + s.chars ELSE f.used END,
   CASE WHEN f.used + s.chars <= 4000 THEN CASE WHEN f.ids = '' THEN '' ELSE f.ids || ',' END || s.id ELSE f.ids END
 FROM fold f JOIN sized s ON s.query_id = f.query_id AND s.position = f.position + 1)
SELECT query_id, used, ids FROM fold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position DESC) = 1""")
def context_pack_greedy(spark, sf_dir):
    packed = reuse.pack_greedy(_page(spark, sf_dir), 4000)
    return packed.select("query_id", "used", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# ---------------------------------------------------------------- search, probes and plans


def _full(spark, sf_dir):
    """search() over all requests. Its enriched index, the records' features and the graph are stored like the plain index."""
    records, edges = _prepared(spark, sf_dir)
    idx = _stored(spark, sf_dir, tx.indexed_text(F.col("title"), F.col("content"), F.col("search_terms")), places=True)
    return search.search(src.search_requests(spark, sf_dir), records, idx=idx, edges=edges)


@query()
def search_full(spark, sf_dir):
    return _full(spark, sf_dir)[0].select("query_id", "id", "origin", "tier", "position")


@query()
def search_omissions(spark, sf_dir):
    return _full(spark, sf_dir)[1]


@query()
def evidence_ladder(spark, sf_dir):
    page = _best(spark, sf_dir, 3).join(src.search_requests(spark, sf_dir).select("query_id", "query"), "query_id").join(src.knowledge_records(spark, sf_dir), "id")
    s = gates.evidence_support(F.col("query"), F.col("title"), F.lit(""), F.col("content"))
    return page.select("query_id", "id", s.alias("s")).select("query_id", "id", "s.supported", "s.reason", F.round("s.score", 6).alias("score"))


@query()
def admission_user_turns(spark, sf_dir):
    """What becomes of each user turn that quotes itself. Clause cuts look ahead, which SQL's patterns cannot; tests/test_statements.py has their cases."""
    said = src.conversations(spark, sf_dir).where("role = 'user'")
    made = said.select(
        "conv_id", "turn", F.lit("durable").alias("declared"), F.lit("user").alias("role"), F.array(F.coalesce("text", F.lit(""))).alias("quotes"), F.lit("preference").alias("knowledge_type"),
        F.coalesce("text", F.lit("")).alias("user_text"), F.lit("").alias("assistant_text"), F.lit(0).alias("n_tools"),
    )
    return statements.admit(made).select("conv_id", "turn", "category", "reason", "admitted_as", F.array_join("kept", "\n").alias("kept"), "proposed_scope", "auto_accept")


# ---------------------------------------------------------------- reports


_RUNS3 = """r3 AS (SELECT o_custkey AS task_id, o_orderkey % 3 AS repeat, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'auto' WHEN o_orderpriority = '5-LOW' THEN 'oracle' ELSE 'baseline' END AS mode,
 'c' || (o_custkey % 4) AS category, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS success, o_orderpriority AS failure_kind, o_orderkey % 7 AS field_hits,
 o_orderkey % 4 AS convention_hits, o_orderkey % 3 AS plain_hits, o_orderkey % 5 AS specific_hits, 5 AS specific_total FROM orders)"""


def _mode_runs(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    return src.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("task_id"), (k % 3).alias("repeat"), F.when(p.isin("1-URGENT", "2-HIGH"), "auto").when(p == "5-LOW", "oracle").otherwise("baseline").alias("mode"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string")).alias("category"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("success"),
        p.alias("failure_kind"), (k % 7).alias("field_hits"), (k % 4).alias("convention_hits"), (k % 3).alias("plain_hits"), (k % 5).alias("specific_hits"), F.lit(5).alias("specific_total"),
    )


@query(f"""WITH {_RUNS3}, t AS (SELECT task_id, repeat, max(category) FILTER (mode = 'auto') AS category, max(success::INT) FILTER (mode = 'baseline') AS a, max(success::INT) FILTER (mode = 'auto') AS b,
 max(success::INT) FILTER (mode = 'oracle') AS c FROM r3 GROUP BY ALL), w AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS whole FROM t)
SELECT CASE grouping(category) WHEN 1 THEN 'all' ELSE category END AS category, count(*) FILTER (whole) AS complete_triples, count(*) FILTER (NOT whole) AS incomplete_triples,
 round(avg(a) FILTER (whole), 6) AS baseline_rate, round(avg(b) FILTER (whole), 6) AS auto_rate, round(avg(c) FILTER (whole), 6) AS oracle_rate, round(avg(b - a) FILTER (whole), 6) AS auto_minus_baseline,
 round(avg(c - b) FILTER (whole), 6) AS oracle_minus_auto, count(*) FILTER (whole AND b = 1 AND a = 0) AS helped, count(*) FILTER (whole AND b = 0 AND a = 1) AS harmed
FROM w GROUP BY GROUPING SETS ((), (category)) HAVING grouping(category) = 1 OR (category IS NOT NULL AND count(*) FILTER (whole) > 0)""")
def extended_paired(spark, sf_dir):
    return reports.extended_paired(_mode_runs(spark, sf_dir))


@query(f"WITH {_RUNS3} SELECT failure_kind, count(*) AS n FROM r3 WHERE success = false GROUP BY 1")
def failure_kinds(spark, sf_dir):
    return reports.failure_kinds(_mode_runs(spark, sf_dir))


@query(f"""WITH {_RUNS3} SELECT mode, count(*) AS n, count(success) AS usable, count(*) - count(success) AS api_errors, round(avg(success::INT), 6) AS task_success_rate,
 round(sum(field_hits) FILTER (success IS NOT NULL) / nullif(6.0::DOUBLE * count(success), 0), 6) AS field_compliance_rate,
 round(sum(convention_hits) FILTER (success IS NOT NULL) / nullif(3.0::DOUBLE * count(success), 0), 6) AS convention_hit_rate,
 round(sum(plain_hits) FILTER (success IS NOT NULL) / nullif(3.0::DOUBLE * count(success), 0), 6) AS plain_field_rate,
 round(sum(specific_hits) FILTER (success IS NOT NULL) / nullif(sum(specific_total) FILTER (success IS NOT NULL)::DOUBLE, 0), 6) AS service_specific_rate FROM r3 GROUP BY 1""")
def field_compliance(spark, sf_dir):
    return reports.field_compliance(_mode_runs(spark, sf_dir))


_CASES = """cs AS (SELECT 'c' || (event_id % 5) AS category, event_type <> 'error' AS decision_correct, CASE WHEN event_id % 3 > 0 THEN (event_id % 3) / 2.0::DOUBLE END AS evidence_recall,
 event_id % 11 = 0 AS forbidden_injected, CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS shadow_candidate_found, CASE WHEN event_id % 6 = 0 THEN event_id % 12 = 0 END AS same_turn_recovery,
 CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN true END AS answer_correct, value AS adapter_ms FROM events)"""


@query(f"""WITH {_CASES} SELECT CASE grouping(category) WHEN 1 THEN 'all' ELSE category END AS category, count(*) AS cases, round(avg(decision_correct::INT), 6) AS decision_accuracy,
 round(avg(evidence_recall), 6) AS positive_evidence_recall, round(avg(decision_correct::INT) FILTER (evidence_recall IS NULL), 6) AS abstention_clean_rate,
 round(avg(forbidden_injected::INT), 6) AS forbidden_injection_rate, round(avg(shadow_candidate_found::INT), 6) AS shadow_candidate_recall, round(avg(same_turn_recovery::INT), 6) AS same_turn_recovery_rate,
 round(avg(answer_correct::INT), 6) AS answer_accuracy, round(count(answer_correct) / count(*)::DOUBLE, 6) AS answer_grade_coverage,
 round(quantile_disc(adapter_ms, 0.5), 3) AS adapter_p50_ms, round(quantile_disc(adapter_ms, 0.95), 3) AS adapter_p95_ms FROM cs GROUP BY GROUPING SETS ((), (category))""")
def cross_agent_score(spark, sf_dir):
    e, i = src.agent_events(spark, sf_dir), F.col("id")
    every = lambda n, flag: F.when(i % n == 0, flag)
    cases = e.select(
        F.concat(F.lit("c"), (i % 5).cast("string")).alias("category"), (F.col("event_type") != "error").alias("decision_correct"), F.when(i % 3 > 0, (i % 3) / 2.0).alias("evidence_recall"),
        (i % 11 == 0).alias("forbidden_injected"), every(4, i % 8 == 0).alias("shadow_candidate_found"), every(6, i % 12 == 0).alias("same_turn_recovery"),
        F.col("success").alias("answer_correct"), F.col("value").alias("adapter_ms"),
    )
    return reports.cross_agent(cases)


@query(f"""WITH {_ARMS}, every AS (SELECT query_id, arm FROM (SELECT query_id FROM arms UNION SELECT query_id FROM gold), (SELECT DISTINCT arm FROM arms)),
n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), h AS (SELECT arm, query_id, count(*) AS n, count(*) FILTER (relevant) AS hits FROM j GROUP BY ALL),
s AS (SELECT arm, query_id, n_gold, coalesce(hits, 0) AS hits, coalesce(n, 0) AS shown FROM every LEFT JOIN n USING (query_id) LEFT JOIN h USING (arm, query_id))
SELECT arm, count(n_gold) AS positive_questions, count(*) - count(n_gold) AS abstention_questions, round(avg((hits > 0)::INT) FILTER (n_gold IS NOT NULL), 6) AS hit,
 round(avg(hits / n_gold::DOUBLE), 6) AS mean_evidence_recall, round(avg((hits = n_gold)::INT) FILTER (n_gold IS NOT NULL), 6) AS complete,
 round(avg((shown = 0)::INT) FILTER (n_gold IS NULL), 6) AS abstention_empty_rate FROM s GROUP BY 1""")
def ablation_summary(spark, sf_dir):
    gold = _gold(spark, sf_dir)
    return reports.ablation(reports.evidence_found(gold, _arms(spark, sf_dir, gold).withColumn("rank", F.lit(1))))


_E2E = """ex AS (SELECT l_orderkey * 8 + l_linenumber AS question_id, CASE WHEN l_tax > 0.04 THEN 'native' ELSE 'retired' END AS scenario, 't' || (l_partkey % 3) AS question_type,
 l_extendedprice AS retrieval_ms, l_quantity::BIGINT AS context_bytes, l_returnflag, l_linestatus, l_discount FROM lineitem),
rs AS (SELECT question_id, scenario, CASE WHEN l_discount > 0.095 THEN 'error' ELSE 'ok' END AS status, l_returnflag = 'A' AS correct, l_linestatus = 'F' AS abstention, retrieval_ms / 2 AS answer_ms FROM ex WHERE scenario = 'retired' OR l_discount > 0.01),
m AS (SELECT ex.*, rs.status, rs.correct, rs.abstention, rs.answer_ms, coalesce(status = 'ok', false) AS good FROM ex LEFT JOIN rs USING (question_id, scenario))"""


@query(f"""WITH {_E2E}
SELECT scenario, 'x' AS arm, count(*) AS expected, count(*) FILTER (good) AS valid, count(*) FILTER (NOT good) AS errors_or_missing,
 CASE WHEN bool_and(good) THEN round(avg(correct::INT) FILTER (good), 6) END AS accuracy, CASE WHEN bool_and(good) THEN round(avg(correct::INT) FILTER (good AND NOT abstention), 6) END AS positive_accuracy,
 CASE WHEN bool_and(good) THEN round(avg(correct::INT) FILTER (good AND abstention), 6) END AS abstention_accuracy, round(count(*) FILTER (good AND correct) / count(*)::DOUBLE, 6) AS lower_bound,
 round(quantile_disc(retrieval_ms, 0.95), 3) AS retrieval_p95_ms, CASE WHEN bool_and(good) THEN round(quantile_disc(answer_ms, 0.95), 3) END AS answer_p95_ms, sum(context_bytes)::BIGINT AS context_bytes
FROM m GROUP BY 1""")
def end_to_end_report(spark, sf_dir):
    i = src.read(spark, sf_dir, "lineitem")
    own = i.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("question_id"), F.when(F.col("l_tax") > 0.04, "native").otherwise("retired").alias("scenario"), F.lit("x").alias("arm"),
        F.concat(F.lit("t"), (F.col("l_partkey") % 3).cast("string")).alias("question_type"), F.col("l_extendedprice").alias("retrieval_ms"), F.col("l_quantity").cast("long").alias("context_bytes"),
        "l_returnflag", "l_linestatus", "l_discount",
    )
    expected = own.select("question_id", "scenario", "arm", "question_type", "retrieval_ms", "context_bytes")
    results = own.where("scenario = 'retired' or l_discount > 0.01").select(
        "question_id", "scenario", "arm", F.when(F.col("l_discount") > 0.095, "error").otherwise("ok").alias("status"), (F.col("l_returnflag") == "A").alias("correct"),
        (F.col("l_linestatus") == "F").alias("abstention"), (F.col("retrieval_ms") / 2).alias("answer_ms"),
    )
    return reports.end_to_end(expected, results)


@query("""WITH a AS (SELECT o_custkey % 50 AS family, CASE o_orderkey % 2 WHEN 0 THEN 'baseline' ELSE 'memory' END AS g, o_orderkey % 3 AS stage, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS success FROM orders),
f AS (SELECT count(DISTINCT family) AS families FROM a)
SELECT g AS "group", stage, round(avg(success::INT), 6) AS success_rate, count(*) FILTER (success = false) AS failures, round(count(*) FILTER (success = false) / any_value(families)::DOUBLE, 6) AS failures_per_family FROM a, f GROUP BY ALL""")
def learning_curve(spark, sf_dir):
    o, k = src.read(spark, sf_dir, "orders"), F.col("o_orderkey")
    return reports.learning_curve(o.select(
        (F.col("o_custkey") % 50).alias("family"), F.when(k % 2 == 0, "baseline").otherwise("memory").alias("group"), (k % 3).alias("stage"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("success"),
    ))


@query(f"WITH {_RUNS} SELECT status, count(*) AS n FROM runs GROUP BY 1")
def queue_summary(spark, sf_dir):
    return reports.queue_summary(src.learning_runs(spark, sf_dir))


_PROBES = f"""{_BM25}, retired AS (SELECT s.*, status FROM scored s JOIN kr USING (id) WHERE status IN ('active', 'stale', 'archived') AND (scope = 'user' OR project_key = 'src0')),
probes AS (SELECT id, query_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM retired QUALIFY rank <= 8) WHERE status = 'archived')"""


def _ledger(spark, sf_dir):
    found = shadow_probe(spark, sf_dir)
    rows = found.select(F.lit("src0").alias("project_key"), F.col("id").alias("knowledge_id"), F.col("query_id").cast("string").alias("query_hash"), F.col("query_id").alias("seq"))
    kr = src.knowledge_records(spark, sf_dir, digest=tx.record_digest(F.col("title"), F.col("content")))
    digests = kr.where("status = 'archived'").select(F.col("id").alias("knowledge_id"), "digest")
    return governance.probe_ledger(rows, digests), kr


@query(f"""WITH {_PROBES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query_id DESC) AS n FROM probes)
SELECT id AS knowledge_id, count(*) AS hits, string_agg(query_id::VARCHAR, ',' ORDER BY query_id) FILTER (n <= 32) AS queries FROM r GROUP BY 1""")
def probe_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)[0].select("knowledge_id", "hits", F.array_join("query_hashes", ",").alias("queries"))


@query(f"WITH {_PROBES} SELECT DISTINCT id, 'archived' AS expected_status, 'active' AS to_status FROM probes")
def resurrect_plan(spark, sf_dir):
    ledger, kr = _ledger(spark, sf_dir)
    return governance.resurrect_plan(ledger, kr.withColumn("superseded_by", F.lit(None).cast("long")))


@query("""WITH g AS (SELECT user_id AS session_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT session_id, floor(epoch(min(ts)))::BIGINT AS started_at, count(*) AS events FROM s GROUP BY session_id, n""")
def activity_sessions(spark, sf_dir):
    e = src.agent_events(spark, sf_dir)
    return streams.activity_sessions(e, "1 day").select("session_id", epoch("started_at"), "events")


@query(f"WITH {_OUT} SELECT k.p_partkey AS id, 'active' AS expected_status, 'quarantined' AS to_status FROM part k JOIN outc ON knowledge_id = p_partkey WHERE failed > 0")
def experience_quarantine(spark, sf_dir):
    e = src.agent_events(spark, sf_dir).select((F.col("session_id") % 500).alias("knowledge_id"), F.col("id").alias("run_id"), "success")
    own = src.catalogue_records(spark, sf_dir).select(F.col("knowledge_id").alias("id"), F.lit("active").alias("status"))
    return experiences.quarantine_plan(own, experiences.outcomes(e))


@query("""SELECT agent_id, enabled, updated_at FROM (SELECT s_suppkey AS agent_id, s_acctbal >= 0 AS enabled, 0::BIGINT AS updated_at FROM supplier
UNION ALL SELECT l_suppkey, bool_and(l_returnflag <> 'R'), max(l_orderkey) FROM lineitem GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY updated_at DESC) = 1""")
def agent_registry(spark, sf_dir):
    known = src.agents(spark, sf_dir).select(F.col("agent_key").alias("agent_id"), "enabled", F.lit(0).cast("long").alias("updated_at"))
    new = src.read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("agent_id")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("enabled"), F.max("l_orderkey").alias("updated_at"))
    return lifecycle.register_agents(known, new)


@query("""SELECT p_partkey AS id, count(l_partkey) AS hit_count, epoch(max(l_shipdate))::BIGINT AS last_hit_at FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_returnflag <> 'N' GROUP BY 1""")
def emission_hits(spark, sf_dir):
    emitted = src.read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_partkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("emitted_at"))
    own = src.catalogue_records(spark, sf_dir).select(F.col("knowledge_id").alias("id"))
    return lifecycle.apply_hits(own, emitted).select("id", "hit_count", epoch("last_hit_at"))


@query(f"WITH {_CLAIMS} SELECT a.id, a.slot, count(b.id) AS n_peers FROM claims a LEFT JOIN claims b ON a.slot = b.slot AND a.value <> b.value GROUP BY ALL")
def slot_peer_counts(spark, sf_dir):
    return versions.peer_counts(_claims(spark, sf_dir))


@query("""WITH gone AS (SELECT p_partkey FROM part WHERE p_size = 1)
SELECT l_orderkey AS id, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM gone)) AS n_items FROM lineitem GROUP BY 1""")
def trace_scrub(spark, sf_dir):
    gone = src.catalogue_records(spark, sf_dir).where("p_size = 1").select(F.col("knowledge_id").alias("id"))
    return reuse.scrubbed(_traces(spark, sf_dir), gone).select("id", F.size("items").cast("long").alias("n_items"))


@query(f"""WITH {_KR} SELECT knowledge_type, scope, grouping(knowledge_type)::BIGINT + grouping(scope)::BIGINT AS level, count(*) AS n, count(*) FILTER (status = 'active') AS active FROM kr
GROUP BY GROUPING SETS ((), (knowledge_type), (knowledge_type, scope))""")
def holdout_levels(spark, sf_dir):
    return evaluate.levels(src.knowledge_records(spark, sf_dir), ["knowledge_type", "scope"], F.col("status") == "active", "active")


@query(f"""WITH {_KR} SELECT id, title, knowledge_type, scope, status, source_agent, round(coalesce(verified_count::DOUBLE / nullif(verified_count + rejected_count, 0), 0), 3) AS confidence,
source_agent <> 'en' AS cross_agent FROM kr""")
def public_records(spark, sf_dir):
    return projections.public(src.knowledge_records(spark, sf_dir), F.lit("en"))


@query(f"""WITH {_KR}, {_EV}, o AS (SELECT knowledge_id AS id, string_agg(DISTINCT agent_id, ',' ORDER BY agent_id) AS agents, bool_or(outcome = 'verified') AS ok FROM ev GROUP BY 1)
SELECT id, coalesce(agents, '') AS agents, CASE WHEN ok THEN 'confirmed' WHEN status IN ('active', 'stale') THEN 'available' ELSE 'private' END AS sharing_state FROM kr LEFT JOIN o USING (id)""")
def sharing_rows(spark, sf_dir):
    rows = projections.sharing(src.knowledge_records(spark, sf_dir), src.evidence(spark, sf_dir))
    return rows.withColumn("agents", F.array_join("agents", ","))


@query(f"""WITH {_TT} SELECT DISTINCT c.id FROM tt c WHERE c.status = 'candidate'
AND EXISTS (SELECT 1 FROM tt s WHERE s.status IN ('active', 'stale') AND s.project_key = c.project_key AND s.term = c.term AND s.id <> c.id)""")
def related_accepted(spark, sf_dir):
    terms = _title_terms(spark, sf_dir)
    return projections.related_accepted(terms.where("status = 'candidate'"), terms.where("status in ('active', 'stale')"))


_SENTENCE, _END = r"^[^.!?]+[.!?]", r"[^.!?]+[.!?]*$"


@query(rf"""WITH {_KR}, b AS (SELECT item_id AS query_id, regexp_extract(text, '{_SENTENCE}') AS quote, regexp_extract(text, '{_END}') AS answer FROM benchmark),
h AS (SELECT query_id, doc_id AS id, text AS content FROM b JOIN documents d ON quote <> '' AND contains(d.text, quote)),
k AS (SELECT h.* FROM h JOIN kr USING (id) WHERE status IN ('active', 'stale', 'candidate')),
w AS (SELECT b.query_id, content, ' ' || array_to_string(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS own,
      ' ' || array_to_string(regexp_extract_all(lower(answer), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS wanted FROM b LEFT JOIN k USING (query_id)),
c AS (SELECT query_id, count(content) AS n, bool_or(coalesce(length(wanted) > 2 AND contains(own, wanted), false)) AS answered FROM w GROUP BY 1)
SELECT CASE WHEN answered THEN 'answer_kept' WHEN n > 0 THEN 'evidence_kept' ELSE 'lost' END AS outcome, count(*) AS cases FROM c GROUP BY 1""")
def retention_audit(spark, sf_dir):
    """A passage's evidence is a document that has its first sentence, the answer is its last one."""
    kept = src.knowledge_records(spark, sf_dir).where("status in ('active', 'stale', 'candidate')").select("id")
    passages = src.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    quote, answer = F.regexp_extract("text", _SENTENCE, 0).alias("quote"), F.regexp_extract("text", _END, 0).alias("answer")
    held = _quoting(spark, sf_dir, quote, answer, told={"holds": holds_literally("text", "answer")})
    return projections.retention_audit(passages, held.join(kept, "id"))


# ---------------------------------------------------------------- relations that change together, claims by scope and state

_STANDING = """pc AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'user' ELSE 'project' END AS scope, p_brand AS project_key, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type || p_size % 4 END AS topic,
 'v' || p_partkey % 3 AS value, CASE p_size % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'active' WHEN 2 THEN 'stale' WHEN 3 THEN 'archived' ELSE 'quarantined' END AS status,
 p_size % 3 AS verified, p_partkey % 13 = 0 AS replaced FROM part),
cl AS (SELECT *, CASE WHEN scope = 'user' THEN 'user' ELSE 'project' || project_key END || '|' || topic AS slot,
 NOT replaced AND (status IN ('active', 'stale') OR status = 'archived' AND verified > 0) AS stands, status IN ('active', 'stale') AS serves FROM pc WHERE topic <> '')"""


def _standing(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    states = F.array(*[F.lit(x) for x in ("candidate", "active", "stale", "archived", "quarantined")])
    return src.read(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(key % 5 == 0, "user").otherwise("project").alias("scope"),
        F.col("p_brand").alias("project_key"),
        F.when(key % 11 == 0, "").otherwise(F.concat("p_type", (size % 4).cast("string"))).alias("claim_topic"),
        F.concat(F.lit("v"), (key % 3).cast("string")).alias("claim_value"),
        F.get(states, (size % 5).cast("int")).alias("status"),
        (size % 3).cast("long").alias("verified_count"),
        F.when(key % 13 == 0, key + 1).alias("superseded_by"),
    )


@query(f"""WITH {_STANDING} SELECT a.id, count(b.id) AS n_peers FROM cl a LEFT JOIN cl b ON a.slot = b.slot AND b.stands AND a.value <> b.value GROUP BY 1""")
def claim_peers(spark, sf_dir):
    return versions.peer_sums(_standing(spark, sf_dir)).select("id", F.col("n_peers").cast("long").alias("n_peers"))


@query(f"""WITH {_STANDING} SELECT a.id, NOT a.replaced AND count(DISTINCT b.value) > 0 AS disputed FROM cl a
LEFT JOIN cl b ON a.slot = b.slot AND b.stands AND a.value <> b.value AND (b.serves OR NOT a.serves) GROUP BY a.id, a.replaced""")
def claim_disputes(spark, sf_dir):
    return versions.disputed(_standing(spark, sf_dir))


@query("""WITH c AS (SELECT p_partkey AS id, p_brand AS b, p_partkey % 4 = 0 AS there FROM part)
SELECT id, last_value(CASE WHEN there THEN id END IGNORE NULLS) OVER (PARTITION BY b ORDER BY id ROWS UNBOUNDED PRECEDING) AS predecessor FROM c QUALIFY NOT there AND predecessor IS NOT NULL""")
def restored_predecessors(spark, sf_dir):
    """Each part replaces the part before it of its brand; three in four are gone."""
    own = src.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("superseded_by"))
    return versions.restored(own, own.where("id % 4 <> 0").select("id")).select("id", "predecessor")


_ORDERS = (
    relations.Relation("orders", "id long, status string, price double", owner="id"),
    relations.Relation("sales", "part long, n long, last long", key=("part",), counts=("n",), stamps=("last",)),
)


def _changed_orders(spark, sf_dir):
    """Orders that came open, of which some were closed later and some removed, and how often each part was sold, less what came back; in four changes and merged."""
    base = relations.Relations(spark, f"{shared_dir(spark)}/tidemark/orders-{uuid.uuid4().hex}", _ORDERS)
    own = src.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("open").alias("status"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    lines = src.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.lit(1).cast("long").alias("n"), F.col("l_orderkey").alias("last"), "l_returnflag")
    sold = lambda rows, sign: rows.groupBy("part").agg((F.sum("n") * sign).alias("n"), F.max("last").alias("last"))
    closed = own.where("o_orderstatus = 'F'").withColumn("status", F.lit("closed"))
    for change in (
        relations.Change(append={"orders": own, "sales": sold(lines, 1)}),
        relations.Change(replace={"orders": closed}),
        relations.Change(append={"sales": sold(lines.where("l_returnflag = 'R'"), -1)}),
        relations.Change(remove={"orders": own.where("id % 3 = 0").select("id")}),
    ):
        base.commit(base.open(), change)
    for name in ("orders", "sales"):
        base.merge(name, whole=True)
    return base.open()


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0")
def relation_upserts(spark, sf_dir):
    return _changed_orders(spark, sf_dir).read("orders")


@query("SELECT l_partkey AS part, count(*) FILTER (l_returnflag <> 'R') AS n, max(l_orderkey) AS last FROM lineitem GROUP BY 1 HAVING n > 0")
def relation_sums(spark, sf_dir):
    return _changed_orders(spark, sf_dir).read("sales")


_SAID = """said AS (SELECT conv_id, text AS a, '{"role": "' || role || '", "turn": ' || turn || ', "extra": {"turn": ' || (turn + 1) || '}}' AS artifact,
 CASE turn % 4 WHEN 0 THEN '{"turn": ' || turn || ', "role": "' || role || '"}' WHEN 1 THEN '{"turn": "' || turn || '"}' WHEN 2 THEN '{"turn": ' || turn || '.0}' ELSE '{"extra": {"turn": ' || (turn + 1) || '}}' END AS wanted, turn FROM conversations)"""


@query(f"WITH {_SAID} SELECT conv_id, turn, artifact, turn % 4 IN (0, 3) AS same FROM said")
def typed_artifacts(spark, sf_dir):
    """Whether a turn, as JSON, has wanted values: keys in another order, a number as text, a whole number as a real one, an inner object."""
    t, turn = F.col("turn").cast("string"), F.col("turn")
    role = F.concat(F.lit('"role": "'), "role", F.lit('"'))
    inner = F.concat(F.lit('"extra": {"turn": '), (turn + 1).cast("string"), F.lit("}"))
    artifact = F.concat(F.lit("{"), role, F.lit(', "turn": '), t, F.lit(", "), inner, F.lit("}"))
    wanted = (
        F.when(turn % 4 == 0, F.concat(F.lit('{"turn": '), t, F.lit(", "), role, F.lit("}")))
        .when(turn % 4 == 1, F.concat(F.lit('{"turn": "'), t, F.lit('"}')))
        .when(turn % 4 == 2, F.concat(F.lit('{"turn": '), t, F.lit(".0}")))
        .otherwise(F.concat(F.lit("{"), inner, F.lit("}")))
    )
    own = src.read(spark, sf_dir, "conversations").withColumns({"artifact": artifact, "wanted": wanted})
    return own.select("conv_id", "turn", "artifact", experiences.artifact_equals(F.col("artifact"), F.col("wanted")).alias("same"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
