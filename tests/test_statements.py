import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiences, statements

SCHEMA = "declared string, role string, quotes array<string>, knowledge_type string, user_text string, assistant_text string, n_tools int"


def value(spark, column, *texts):
    names = ["t", "u", "v"][: len(texts)]
    schema = ", ".join(f"{n} {'array<string>' if isinstance(x, list) else 'string'}" for n, x in zip(names, texts))
    return spark.createDataFrame([texts], schema).select(column.alias("x")).head().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("I use Linux. We run Postgres at home.", ["I use Linux.", " We run Postgres at home."]),
        ("My editor is vim, but I am planning to try emacs.", ["My editor is vim", ",", " ", "but", " I am planning to try emacs."]),
        ("I use Postgres 9.6, e.g. at work.", ["I use Postgres 9.6, e.g. at work."]),
        ("I live in Rome, can you find a map?", ["I live in Rome, ", "can you find a map?"]),
        ('He said "I use vim. I like it" today.', ['He said "I use vim. I like it" today.']),
        ("If it rains, I use the car.", ["If it rains, I use the car."]),
        ("I use vim (and I am happy).", ["I use vim (and I am happy)."]),
        ("My service uses mode a) (my cache has pages, and our app runs Python) daily.", ["My service uses mode a) (my cache has pages, and our app runs Python) daily."]),
        ("第一。第二？", ["第一。", "第二？"]),
        ("", []),
    ],
)
def test_units_are_the_text(spark, text, want):
    got = value(spark, statements.units(F.col("t")), text)
    assert [u.text for u in got] == want and "".join(u.text for u in got) == text
    assert [u.start for u in got] == [sum(len(w) for w in want[:i]) for i in range(len(want))]


def test_context_takes_qualifying_neighbours_only(spark):
    source = "The cache is off. This is only temporary. We use Redis for queues. Not sure why."
    around = lambda q: value(spark, statements.context(F.col("t"), F.array("u")), source, q)
    assert around("The cache is off") == "The cache is off. This is only temporary."
    assert around("We use Redis") == " This is only temporary. We use Redis for queues."
    assert around("nowhere") == ""
    assert value(spark, statements.context(F.col("t"), F.array("u")), "one two. three four. one two.", "one two") == "one two.\n one two."


@pytest.mark.parametrize(
    "source, quote, want",
    [
        ("We do not use Redis in production.", "use Redis in production", True),
        ("We use Redis in production.", "We use Redis in production.", False),
        ("If the disk is full, we use Redis.", "we use Redis", True),
        ("We use Redis. We never use Kafka.", "We use Redis.", False),
    ],
)
def test_clipped_restrictions(spark, source, quote, want):
    assert value(spark, statements.clipped(F.col("t"), F.array("u")), source, quote) is want


@pytest.mark.parametrize(
    "text, want",
    [
        ("From now on, answer in English.", True),
        ("From now on, always be kind.", False),
        ("Always use tabs. Use spaces for this task.", False),
        ("Always use tabs and keep lines short.", True),
        ("Should I always use tabs?", False),
        ('Always write "hello".', False),
        ("默认使用中文回答。", True),
        ("The default is fine.", False),
    ],
)
def test_stable_directives(spark, text, want):
    assert value(spark, statements.stable_directive(F.col("t")), text) is want


def admitted(spark, text, quotes=None, **other):
    row = dict(declared="durable", role="user", quotes=quotes or [text], knowledge_type="preference", user_text=text, assistant_text="", n_tools=0) | other
    return statements.admit(spark.createDataFrame([row], SCHEMA)).head()


def test_mixed_statements_keep_what_stands(spark):
    r = admitted(spark, "My editor is vim, but I am planning to try emacs.")
    assert (r.reason, r.admitted_as, r.kept, r.auto_accept) == (None, "independent_source_assertions", ["My editor is vim"], False)
    r = admitted(spark, "I use Postgres at work. Maybe we switch to MySQL.")
    assert r.reason is None and r.kept == ["I use Postgres at work."]
    r = admitted(spark, "Maybe we switch to MySQL next year.")
    assert (r.reason, r.kept) == ("uncertain_knowledge", None)


@pytest.mark.parametrize(
    "text, other, reason, named, accept",
    [
        ("From now on, answer in English.", {}, None, "stable_user_directive", True),
        ("From now on, answer in English.", {"knowledge_type": "fact"}, None, "requires_review", False),
        ("Please check the build of the server.", {}, "task_instruction_not_knowledge", None, False),
        ("The password is hunter2 for all hosts.", {}, "sensitive_content", None, False),
        ("Do not remember that I use Linux here.", {}, "not_authorized", None, False),
        ("We use Linux on every server here.", {"declared": "eternal"}, "invalid_retention", None, False),
        ("We use Linux on every server here.", {"role": "assistant", "assistant_text": "We use Linux on every server here."}, "assistant_without_observed_work", None, False),
        ("We use Linux on every server here.", {"quotes": ["We use Windows on all"]}, "not_verbatim", None, False),
        ("Remember from now on: maybe the port is 80.", {}, None, "explicit_retention_uncertain", False),
    ],
)
def test_admission_ladder(spark, text, other, reason, named, accept):
    r = admitted(spark, text, **other)
    assert (r.reason, r.admitted_as, r.auto_accept) == (reason, named, accept)


def test_quotes_that_cover_a_rule_together_are_the_whole_rule(spark):
    rule = "Always use tabs and keep lines short."
    rows = [(1, 1, "user", "preference", "durable", ["Always use tabs"], rule), (1, 2, "user", "preference", "durable", ["and keep lines short"], rule),
            (2, 1, "user", "preference", "durable", ["Always use tabs"], rule), (2, 2, "user", "preference", "durable", ["keep lines short"], rule),
            (3, 1, "user", "preference", "durable", ["Always use tabs"], rule), (3, 2, "user", "decision", "durable", ["and keep lines short"], rule)]
    df = spark.createDataFrame(rows, "turn_id int, n int, role string, knowledge_type string, declared string, quotes array<string>, user_text string")
    got = {(r.turn_id, r.n): r.quotes for r in statements.complete_directive_quotes(df).collect()}
    assert got[1, 1] == got[1, 2] == [rule]
    assert got[2, 1] == ["Always use tabs"] and got[3, 2] == ["and keep lines short"]


@pytest.mark.parametrize(
    "source, content, want",
    [("  whole text ", "kept: whole text", [(2, 12)]), ("one two three two", "one\ntwo\ntwo", [(0, 3), (4, 7), (14, 17)]), ("one two", "two\none", None), ("one", "\n", None)],
)
def test_retained_spans(spark, source, content, want):
    got = value(spark, statements.retained_spans(F.col("t"), F.col("u")), source, content)
    assert (got and [tuple(s) for s in got]) == want


CONTRACT = "struct<applies_when:array<string>,exclude_when:array<string>>"


@pytest.mark.parametrize(
    "applies, excludes, query, want",
    [
        (["ledger"], ["windows"], "deploy the ledger on windows, not windows 7", False),
        (["ledger"], ["windows"], "ledger on linux, not windows", True),
        (["ledger"], ["windows"], "the ledger is not true on windows", False),
        (["ledger"], ["windows"], "ledger; windows is unsupported", True),
        (["ledger"], ["windows"], "ledger: windows is unsupported?", False),
        (["ledger"], ["Windows 不适用"], "ledger 部署到 Windows", False),
        (["修复 ledger 部署问题"], [], "ledger 怎么部署", True),
        (["修复 ledger 部署问题"], [], "ledger 怎么升级", False),
        (["ledger or cache"], [], "the cache", False),
        (["ledger"], [], "not ledger but cache", False),
        (["ledger"], [], "ledgers only", False),
    ],
)
def test_applicability(spark, applies, excludes, query, want):
    df = spark.createDataFrame([(applies, excludes, query)], "a array<string>, e array<string>, q string")
    own = F.struct(F.col("a").alias("applies_when"), F.col("e").alias("exclude_when"))
    assert df.select(experiences.applicable(own, F.col("q")).alias("x")).head().x is want


def test_failures_and_recoveries(spark):
    rows = [(1, "t", 1, "a", False, True), (1, "t", 2, "b", True, True), (2, "t", 1, "c", False, True), (3, "t", 1, "d", False, True), (3, "u", 2, "e", False, True), (4, "t", 1, "f", False, True), (4, "t", 2, "g", None, False)]
    runs = spark.createDataFrame(rows, "turn_id int, command string, seq int, event_id string, success boolean, cited boolean")
    assert [tuple(r) for r in experiences.failed_then_passed(runs).collect()] == [(1, "t", "a", "b")]
    assert {(r.turn_id, r.state) for r in experiences.observed_failures(runs).collect()} == {(2, "failing"), (4, "unknown")}
