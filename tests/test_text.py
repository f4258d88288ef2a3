import pytest
from pyspark.sql import functions as F

from tidemark.functions import concepts, text
from tidemark.operators import gates


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).head().x


@pytest.mark.parametrize(
    "value, want",
    [
        ("Ünïcode café-Bar 42", ["unicode", "cafe", "bar", "42"]),
        ("", []),
        ("数据库 lock", ["数据库", "lock"]),
    ],
)
def test_tokens(spark, value, want):
    assert one(spark, value, text.tokens) == want


def test_cjk_ngrams_in_first_seen_order(spark):
    assert one(spark, "第三方 x 三方", text.cjk_ngrams) == ["第三", "三方", "第三方"]


def test_evidence_terms_undo_inflection_and_drop_stop_words(spark):
    assert set(one(spark, "What are the queries about 12 readers and 第三方?", text.evidence_terms)) == {"query", "read", "第三方", "第三", "三方"}


def test_identifiers(spark):
    assert set(one(spark, "HTTP and MCP use project_key, iPhone or ledger-svc; Word", text.distinctive_identifiers)) == {"mcp", "project_key", "ledger-svc"}
    assert one(spark, "a ledger-svc and Ledger-Svc v1.2", text.composite_identifiers) == ["ledger-svc", "v1.2"]


def test_redaction(spark):
    got = one(spark, "sk-abcdefghijklmnop and Bearer abcdefghijklmnop api_key: 'x y' password=hunter2, fine", text.redact)
    assert got == "[REDACTED] and Bearer [REDACTED] api_key: [REDACTED] password=[REDACTED], fine"


def test_concepts_markers_and_aliases(spark):
    query = "Why is the database locked during concurrent writes?"
    assert set(one(spark, query, concepts.concepts)) == {"database", "concurrency", "write", "lock"}
    assert one(spark, query, concepts.markers)[0] == "concept_concurrency"
    assert one(spark, query, concepts.aliases)[:4] == ["database", "concurrent", "write", "locked"]


def test_query_tokens_are_bounded_and_keep_words_first(spark):
    got = one(spark, "reads of ledger-svc " + " ".join(f"w{i}x" for i in range(200)), text.query_tokens)
    assert len(got) == 64 and got[:3] == ["read", "reads", "of"] and len(set(got)) == 64


def test_sentence_units(spark):
    assert one(spark, "One is 1.5 s. Two!  Three？四。", text.sentence_units) == ["One is 1.5 s.", "Two!", "Three", "四"]


def support(spark, query, title, body="", terms=""):
    df = spark.createDataFrame([(query, title, terms, body)], "q string, t string, s string, b string")
    r = df.select(gates.evidence_support(F.col("q"), F.col("t"), F.col("s"), F.col("b")).alias("x")).head().x
    return r.supported, r.reason, round(r.score, 2)


@pytest.mark.parametrize(
    "args, want",
    [
        (("ledger retention policy", "Ledger retention"), (True, "topic_match", 0.8)),
        (("ledger retention policy", "Other", "the ledger has a retention of 3 days"), (True, "multi_term_evidence", 0.61)),
        (("ledger", "Other", "about the ledger"), (True, "single_distinctive_term", 0.4)),
        (("the and of", "x"), (False, "generic_term_only", 0.0)),
        (("ledger colour shape", "Other", "the ledger"), (False, "insufficient_evidence", 0.2)),
        (("ledger colour shape", "Other", "nothing"), (False, "generic_term_only", 0.0)),
        (("数据库并发如何处理", "x", "database concurrency is handled"), (True, "bilingual_evidence", 0.7)),
        (("中转第三方论文", "第三方论文"), (True, "topic_match", 0.7)),
        (("explain MCP to people", "x", "the MCP"), (True, "technical_identifier", 0.55)),
    ],
)
def test_evidence_ladder(spark, args, want):
    assert support(spark, *args) == want


def intent(spark, query):
    return one(spark, query, gates.query_intent)


def test_intent(spark):
    assert intent(spark, "Do not use any memory here: what is TCP?").memory_disabled
    assert intent(spark, "What is a mutex?").general_explanation
    assert not intent(spark, "What is my default editor?").general_explanation
    got = intent(spark, "Fix the bug; do not mention ledger colours. Thanks")
    assert got.excluded == ["ledger colours"] and "ledger" not in got.focus
    assert intent(spark, "show the previous decision on ports").historical
    assert not intent(spark, 'print "previous decision"').historical


ROW = dict(id=1, title="Ledger colours", content="The ledger uses teal.", scope="project", knowledge_type="decision", status="active",
           superseded_by=None, claim_fingerprint="", fingerprint="", claim_conflicted=False, subject_terms=[], search_terms="")
SCHEMA = """id long, title string, content string, scope string, knowledge_type string, status string, superseded_by string, claim_fingerprint string,
 fingerprint string, claim_conflicted boolean, subject_terms array<string>, search_terms string"""


@pytest.mark.parametrize(
    "query, change, want",
    [
        ("ledger colours", {}, None),
        ("ledger colours", {"superseded_by": "9"}, "superseded_version"),
        ("previous decision on ledger colours", {"superseded_by": "9"}, None),
        ("previous decision on ledger", {"status": "archived"}, "ordinary_archive_not_version_history"),
        ("ledger", {"claim_fingerprint": "a", "fingerprint": "b"}, "assertion_source_changed"),
        ("ledger", {"claim_conflicted": True}, "unresolved_value_conflict"),
        ("do not use any memory for the ledger", {}, "memory_opt_out"),
        ("ledger", {"content": "This rule has been revoked."}, "explicitly_obsolete"),
        ("ledger", {"content": "See whether, if this rule is revoked, it applies."}, None),
        ("ledger", {"title": "Old ledger", "content": "It was superseded by the new one."}, "explicitly_obsolete"),
        ("what is a ledger", {"knowledge_type": "preference"}, "general_question_not_preference_use"),
        ("explain ports; do not use ledger colours.", {}, "explicitly_excluded"),
    ],
)
def test_decision_rejections_in_order(spark, query, change, want):
    rows = spark.createDataFrame([{**ROW, **change}], SCHEMA).withColumn("query", F.lit(query))
    assert rows.select(gates.decision_rejection(gates.query_intent(F.col("query"))).alias("r")).head().r == want


@pytest.mark.parametrize(
    "query, content, want",
    [
        ("what is the timeout limit of the ledger", "The ledger timeout limit is 30 seconds.", None),
        ("what is the timeout limit of the ledger", "The ledger has a timeout.", "missing_numeric_answer"),
        ("what is the timeout limit of the ledger", "If we had one, the ledger timeout limit is 30 seconds.", "missing_numeric_answer"),
        ("did the benchmark result improve accuracy of ledger", "The ledger accuracy was measured at 93 %.", None),
        ("did the benchmark result improve accuracy of ledger", "The ledger accuracy is 93.", "missing_measured_answer"),
        ("how should the ledger close", "This is only a discussion.", "discussion_without_guidance"),
        ("tell me of the ledger", "Nothing.", None),
    ],
)
def test_answer_contract(spark, query, content, want):
    df = spark.createDataFrame([(query, content)], "q string, c string")
    assert df.select(gates.answer_contract_rejection(F.col("q"), F.col("c")).alias("r")).head().r == want


@pytest.mark.parametrize(
    "query, subjects, want",
    [
        ("what does caroline plan", ["caroline"], "subject_match"),
        ("what does caroline plan", ["melanie"], "subject_mismatch"),
        ("what does anyone plan", ["melanie"], "subject_unresolved"),
        ("what does carolines plan", ["caroline"], "subject_unresolved"),
        ("x", [], "no_subject_metadata"),
    ],
)
def test_subjects(spark, query, subjects, want):
    df = spark.createDataFrame([(query, subjects, ["caroline", "melanie"])], "q string, s array<string>, v array<string>")
    assert df.select(gates.subject_reason(F.col("q"), F.col("s"), F.col("v")).alias("r")).head().r == want


def test_answerability_of_a_page(spark):
    def page(*rows):
        schema = "query_id long, id long, query string, title string, search_terms string, content string, subject_terms array<string>, source_session string"
        made = [(1, i, "what did caroline choose about databases", "t", "", c, s, sess) for i, (c, s, sess) in enumerate(rows)]
        return [r.answer_reason for r in gates.answerability(spark.createDataFrame(made, schema)).orderBy("id").collect()]

    who = ["caroline"]
    assert page(("she chose databases", who, "a:1"), ("a race", who, "b:1"), ("no subject", [], None)) == [None, "not_a_supporting_unit", None]
    assert page(("she chose", who, "a:1"), ("databases", who, "a:2")) == [None, None]
    assert page(("she chose", who, "a:1"), ("databases", who, "b:2")) == ["insufficient_answer_evidence"] * 2
    assert page(("a race", [], None),) == [None]


@pytest.mark.parametrize(
    "declared, value, want",
    [
        ("durable", "The ledger closes daily.", "durable"),
        ("durable", "Maybe the ledger closes daily.", "uncertain"),
        ("durable", "For now the ledger closes daily.", "temporary"),
        ("temporary", "The ledger closes daily.", "temporary"),
        ("durable", "Does the ledger close?", "uncertain"),
    ],
)
def test_retention(spark, declared, value, want):
    assert one(spark, value, lambda t: gates.retention(F.lit(declared), t)) == want


def test_sensitive(spark):
    assert one(spark, "remember the password", gates.sensitive_reason) == "sensitive_storage_request"
    assert one(spark, "the api key is abc123", gates.sensitive_reason) == "sensitive_content"
    assert one(spark, "the token budget is 4000", gates.sensitive_reason) is None


def test_admission(spark):
    user = "From now on always use teal for the ledger. Maybe we add red."
    rows = [
        ("durable", "user", ["always use teal for the ledger"], user, "", 0),
        ("durable", "user", ["always use pink for the ledger"], user, "", 0),
        ("durable", "user", ["Maybe we add red."], user, "", 0),
        ("durable", "assistant", ["The ledger is teal."], "x", "The ledger is teal.", 0),
        ("durable", "assistant", ["The ledger is teal."], "x", "The ledger is teal.", 2),
        ("durable", "user", ["short"], user, "", 0),
        ("durable", "user", ["do not save this ledger note"], "do not save this ledger note", "", 0),
        ("durable", "user", ["For all my projects use teal text."], "For all my projects use teal text.", "", 0),
    ]
    df = spark.createDataFrame(rows, "declared string, role string, quotes array<string>, user_text string, assistant_text string, n_tools int")
    got = [(r.reason, r.proposed_scope) for r in gates.admission(df).collect()]
    assert [x for x, _ in got] == [None, "not_verbatim", "uncertain_knowledge", "assistant_without_observed_work", None, "not_verbatim", "not_authorized", None]
    assert got[-1][1] == "user" and got[0][1] == "project"
