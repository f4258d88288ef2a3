"""Statements: which clauses of a text stand by themselves, what qualifies a quote, and which quotes cover a whole rule.

A text is a list of units (start, text) whose texts, one after the other, are the text. Cuts are made where a pattern says
so and never inside of quotations; a unit is judged by patterns alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.parsers import ABBREVIATIONS, stripped
from .gates import has, let, retention, sensitive_reason, unquoted

_CUT, _QUIET = "\x01", "\x02"
_ANY = "(?iU)"
LEAST, MOST, KEPT, WHOLE = 8, 600, 3, 1000


def quoted_evidence(text: Column) -> Column:
    """Whether a text quotes, or begins a quotation."""
    return has(text, P.QUOTED) | has(text, P.LOOSE_QUOTE)


def _marked_stops(text: Column) -> Column:
    """A text with a mark after each stop of a sentence; dots of decimals, initials and abbreviations are none."""
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    quiet = rf"(?i)(?<![A-Za-z.])({names}|[a-z](?:\.[a-z])*)\.(?=\s|$)"
    # quiet dots are set aside while the others are marked
    aside = F.regexp_replace(text, quiet, f"$1{_QUIET}")
    marked = F.regexp_replace(F.regexp_replace(aside, r"\.(?=\s|$)", f".{_CUT}"), "([。！？!?；;\n])", f"$1{_CUT}")
    return F.replace(marked, F.lit(_QUIET), F.lit("."))


def _pieces(text: Column, pattern: str) -> Column:
    """The parts of a text between matches and the matches, in turn: all of it, in order."""
    parts = F.split(text, _ANY + pattern, -1)
    found = F.concat(F.regexp_extract_all(text, F.lit(_ANY + pattern), F.lit(0)), F.array(F.lit("")))
    return F.flatten(F.zip_with(parts, found, lambda p, f: F.array(p, f)))


def clause_head(text: Column) -> Column:
    """Whether a text begins a statement with a subject of its own, and not a fragment that hangs on another."""
    own = F.regexp_replace(stripped(text), _ANY + P.DISCOURSE, "")
    fragment = rf"^(?:{P.UNCERTAIN_FRAGMENT}|{P.TEMPORARY_FRAGMENT})"
    hangs = has(own, P.DEPENDENT_HEAD) | has(own, P.DEPENDENT_ASSERTION) | has(own, P.EPISTEMIC_HEAD) | has(own, fragment)
    intent = has(own, P.INTENT_OR_REQUEST)
    return (own != "") & ~hangs & (has(own, P.EXPLICIT_SUBJECT) | intent) & (has(own, P.DECLARATIVE) | intent)


def _open_brackets(text: Column) -> Column:
    """How many brackets are open at a text's end; one that closes nothing counts for nothing."""
    brackets = F.split(F.regexp_replace(text, r"[^(\[{（【)\]}）】]", ""), "")
    step = lambda n, c: F.when(c.isin(*"([{（【"), n + 1).when(c == "", n).otherwise(F.greatest(n - 1, F.lit(0)))
    return F.aggregate(brackets, F.lit(0), step)


def _coordinated(sentence: Column) -> Column:
    """A sentence with marks around each coordinator that parts two independent statements, outside of brackets."""

    def mark(pieces: Column) -> Column:
        text_of = lambda a, n: F.array_join(F.slice(pieces, a, n), "")

        def piece(p: Column, i: Column) -> Column:
            left, right = text_of(F.lit(1), i), text_of(i + 2, F.size(pieces))
            alone = (
                (_open_brackets(left) == 0) & clause_head(left) & clause_head(right) & ~has(left, P.UNCERTAIN) & ~has(left, P.TEMPORARY) & ~has(left, P.ATTRIBUTED)
            )
            # every second piece is a coordinator; the last of them is the empty end
            return F.when((i % 2 == 1) & (p != "") & alone, F.concat(F.lit(_CUT), p, F.lit(_CUT))).otherwise(p)

        return F.array_join(F.transform(pieces, piece), "")

    return F.when(quoted_evidence(sentence) | ~has(sentence, P.COORDINATOR), sentence).otherwise(let(_pieces(sentence, P.COORDINATOR), mark))


def _units_of(marked: Column) -> Column:
    parts = F.filter(F.split(marked, _CUT, -1), lambda p: p != "")
    start = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, p: a + F.char_length(p))
    return F.transform(parts, lambda p, i: F.struct(start(i).alias("start"), p.alias("text")))


def sentence_parts(text: Column) -> Column:
    """The sentences of a text, verbatim and whole: joined they are the text."""
    return F.filter(F.split(_marked_stops(text), _CUT, -1), lambda p: p != "")


def units(text: Column) -> Column:
    """The units (start, text) of a text: sentences, independent clauses, and clauses that ask or qualify."""
    sentences = F.transform(sentence_parts(text), _coordinated)
    clauses = F.regexp_replace(F.array_join(sentences, _CUT), _ANY + f"({P.CLAUSE_BOUNDARY})", f"$1{_CUT}")
    # marks inside of quotations are none; a quotation may hold marks when it is looked for
    inside = _pieces(clauses, P.QUOTED)
    clean = F.array_join(F.transform(inside, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(_CUT), F.lit(""))).otherwise(p)), "")
    return _units_of(clean)


def qualifier(text: Column) -> Column:
    """uncertain or temporary, of a fragment that does nothing but qualify its neighbour; else null."""
    whole = lambda f: has(stripped(text), P.QUALIFIER_LEAD + f + P.QUALIFIER_TAIL)
    return F.when(whole(P.UNCERTAIN_FRAGMENT), "uncertain").when(whole(P.TEMPORARY_FRAGMENT), "temporary")


def _occurrences(source: Column, quote: Column) -> Column:
    """Where a quote starts in its source, from 0, each place once; a place inside of another occurrence is not looked for."""
    gaps = F.split(source, F.concat(F.lit("\\Q"), quote, F.lit("\\E")), -1)
    n = F.char_length(quote)
    before = lambda i: F.aggregate(F.slice(gaps, F.lit(1), i), F.lit(0), lambda a, g: a + F.char_length(g)) + n * (i - 1)
    return F.when(F.size(gaps) > 1, F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), before)).otherwise(F.array().cast("array<int>"))


def context(source: Column, quotes: Column) -> Column:
    """What stands around quotes: the units that they are in, with the neighbours that do nothing but qualify them."""

    def around(v: Column) -> Column:
        own = v["units"]

        def wide(quote: Column) -> Column:
            def one(p: Column) -> Column:
                end = p + F.char_length(quote)
                first = F.greatest(F.size(F.filter(own, lambda u: u["start"] <= p)), F.lit(1))
                last = F.greatest(F.size(F.filter(own, lambda u: u["start"] < end)), first)
                places = lambda low, high: F.filter(F.transform(own, lambda u, i: F.struct((i + 1).alias("i"), qualifier(u["text"]).isNotNull().alias("q"))), lambda x: (x["i"] >= low) & (x["i"] <= high) & ~x["q"])
                low = F.coalesce(F.array_max(F.transform(places(F.lit(1), first - 1), lambda x: x["i"])), F.lit(0)) + 1
                high = F.coalesce(F.array_min(F.transform(places(last + 1, F.size(own)), lambda x: x["i"])), F.size(own) + 1) - 1
                return F.array_join(F.transform(F.slice(own, low, high - low + 1), lambda u: u["text"]), "")

            return F.transform(_occurrences(source, quote), one)

        return F.array_join(F.array_distinct(F.flatten(F.transform(quotes, wide))), "\n")

    return let(F.struct(units(source).alias("units")), around)


def clipped(source: Column, quotes: Column) -> Column:
    """Whether a quote leaves out what its context says against it: a condition, an intent, a negation or a limit."""
    marks = lambda t: F.regexp_extract_all(F.lower(t), F.lit(_ANY + P.RESTRICTION_MARKER), F.lit(0))

    def one(q: Column) -> Column:
        def judge(c: Column) -> Column:
            framed = has(c, P.ATTRIBUTED) | has(F.regexp_replace(c, _ANY + P.DISCOURSE, ""), P.INTENT_OR_REQUEST)
            return (c != stripped(q)) & (framed | (marks(c) != marks(q)))

        return let(stripped(context(source, F.array(q))), judge)

    return F.exists(quotes, one)


def mixed_intent(quotes: Column) -> Column:
    """Whether a sentence of a quote joins an intent or request with a statement that stands by itself."""

    def joins(sentence: Column) -> Column:
        parts = F.transform(F.split(_coordinated(sentence), _CUT, -1), lambda p: F.regexp_replace(stripped(p), _ANY + P.DISCOURSE, ""))
        intent = lambda p: has(p, P.INTENT_OR_REQUEST)
        return (F.size(parts) > 1) & F.exists(parts, intent) & F.exists(parts, lambda p: clause_head(p) & ~intent(p))

    return F.exists(quotes, lambda q: F.exists(sentence_parts(q), joins))


def independent_assertions(declared: Column, source: Column, quotes: Column) -> Column:
    """At most three verbatim statements of quotes that stand by themselves and are durable; nothing is borrowed from elsewhere."""

    def sound(u: Column) -> Column:
        said = F.regexp_replace(u, _ANY + P.DISCOURSE, "")
        stands = ~has(said, P.NON_ASSERTION) & ~has(said, P.INTENT_OR_REQUEST) & ~has(said, P.DEPENDENT_ASSERTION) & has(said, P.DECLARATIVE) & ~quoted_evidence(u)
        around = lambda c: sensitive_reason(c).isNull() & ~has(unquoted(c), P.DENY_STORAGE) & (retention(F.lit("durable"), c) == "durable") & ~_qualified(c)
        return F.char_length(u).between(LEAST, MOST) & stands & let(context(source, F.array(u)), around) & ~clipped(source, F.array(u))

    ordered = F.transform(F.array_sort(F.transform(quotes, lambda q: F.struct(F.position(q, source).alias("at"), q.alias("q")))), lambda x: x["q"])
    open_ = F.filter(ordered, lambda q: ~quoted_evidence(q))
    texts = F.flatten(F.transform(open_, lambda q: F.transform(units(q), lambda u: stripped(F.regexp_replace(stripped(u["text"]), "[,，]+$", "")))))
    return F.when(declared == "durable", F.slice(F.filter(F.array_distinct(texts), sound), 1, KEPT)).otherwise(F.array().cast("array<string>"))


def _qualified(text: Column) -> Column:
    """Whether a clause of a text does nothing but qualify it."""
    return F.exists(F.flatten(F.transform(sentence_parts(unquoted(text)), lambda s: F.split(s, _ANY + P.ACTIVATION_PARTS))), lambda c: qualifier(c).isNotNull())


def assertion_clauses(text: Column) -> Column:
    """The clauses of a text, for whoever asks whether each of them is an instruction."""
    own = text
    for lead in P.NEUTRAL_LEADS:
        own = F.regexp_replace(own, _ANY + lead, "$1 ")
    parts = F.flatten(F.transform(sentence_parts(own), lambda s: F.transform(F.split(s, _ANY + P.ACTIVATION_PARTS), stripped)))
    return F.filter(parts, lambda p: p != "")


def stable_directive(text: Column) -> Column:
    """A lasting, unconditional instruction: each sentence gives one, and its further clauses continue it."""

    def instructs(sentence: Column) -> Column:
        def all_of(clauses: Column) -> Column:
            first, rest = F.try_element_at(clauses, F.lit(1)), F.slice(clauses, F.lit(2), F.size(clauses) + 1)
            return F.coalesce(has(first, P.DIRECTIVE), F.lit(False)) & F.forall(rest, lambda c: has(c, P.DIRECTIVE) | has(c, P.CONTINUATION_DIRECTIVE))

        return let(assertion_clauses(sentence), all_of)

    sentences = F.filter(F.transform(sentence_parts(text), stripped), lambda s: s != "")
    plain = ~quoted_evidence(text) & has(text, P.LONG_TERM) & ~has(text, P.QUESTION) & ~has(text, P.ATTRIBUTED)
    return plain & (F.size(sentences) > 0) & F.forall(sentences, instructs)


def single_directive(text: Column) -> Column:
    return (F.size(F.filter(sentence_parts(text), lambda s: stripped(s) != "")) == 1) & stable_directive(text)


def task_only(text: Column) -> Column:
    """A bounded command for a task, which is no durable fact merely because it is quoted."""
    return has(text, P.TASK_ONLY) & ~stable_directive(text)


def canonical_quote(text: Column) -> Column:
    return F.regexp_replace(text, _ANY + P.CONFIRMATION_LEAD, "")


def uncovered(source: Column, quotes: Column) -> Column:
    """The letters, digits, underscores and hyphens of a source that no quote covers, in order."""
    spans = F.flatten(F.transform(quotes, lambda q: F.transform(_occurrences(source, q), lambda p: F.struct(p.alias("a"), (p + F.char_length(q)).alias("b")))))
    places = F.sequence(F.lit(0), F.greatest(F.char_length(source) - 1, F.lit(0)))
    open_ = F.filter(places, lambda i: ~F.exists(spans, lambda s: (s["a"] <= i) & (i < s["b"])))
    return F.regexp_replace(F.array_join(F.transform(open_, lambda i: F.substr(source, i + 1, F.lit(1))), ""), r"[^\p{L}\p{N}_-]", "")


def complete_directive_quotes(proposals: DataFrame) -> DataFrame:
    """Proposals (turn_id, n, role, knowledge_type, declared, quotes, user_text), which quote the whole text where those of a turn cover one rule together.

    A rule is a stable directive of up to 1000 characters, covered by two or more durable proposals of one kind with verbatim quotes. A turn has few proposals.
    """
    source = stripped(F.col("user_text"))
    fits = (
        (F.coalesce("role", F.lit("user")) == "user")
        & F.col("knowledge_type").isin("preference", "decision")
        & (F.coalesce("declared", F.lit("durable")) == "durable")
        & F.size("quotes").between(1, 3)
        & F.forall("quotes", lambda q: (F.char_length(q) >= LEAST) & F.contains(source, q))
    )
    turns = proposals.groupBy("turn_id").agg(
        F.count("*").alias("n_proposals"),
        F.countDistinct("knowledge_type").alias("kinds"),
        F.bool_and(F.coalesce(fits, F.lit(False))).alias("fit"),
        F.first("user_text").alias("user_text"),
        F.flatten(F.collect_list("quotes")).alias("every"),
    )
    whole = turns.where("n_proposals >= 2 and kinds = 1 and fit").where((F.char_length(source) <= WHOLE) & stable_directive(source))
    covered = whole.where(uncovered(source, F.col("every")) == "").select("turn_id", F.lit(True).alias("__covered"))
    met = proposals.join(covered, "turn_id", "left")
    return met.withColumn("quotes", F.when(F.col("__covered"), F.array(source)).otherwise(F.col("quotes"))).drop("__covered")


def retained_spans(source: Column, content: Column) -> Column:
    """Offsets (start, end) of kept text in its source: the whole of it, or its lines one after the other; null if they are not there in order."""
    whole = stripped(source)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(True).alias("ok"))
    lines = F.filter(F.transform(F.split(content, "\r?\n"), stripped), lambda x: x != "")

    def step(a: Column, line: Column) -> Column:
        p = F.position(line, source, a["at"] + 1) - 1
        end = p + F.char_length(line)
        return F.struct(
            F.when(p >= 0, end).otherwise(a["at"]).alias("at"), F.array_append(a["spans"], F.struct(p.alias("start"), end.alias("end"))).alias("spans"), (a["ok"] & (p >= 0)).alias("ok")
        )

    one = F.position(whole, source) - 1
    folded = F.aggregate(lines, start, step)
    parts = let(folded, lambda f: F.when(f["ok"] & (F.size(f["spans"]) > 0), f["spans"]))
    return F.when((whole != "") & F.contains(content, whole), F.array(F.struct(one.alias("start"), (one + F.char_length(whole)).alias("end")))).otherwise(parts)


def requests_retention(text: Column, activates: bool = False) -> Column:
    """Whether a sentence asks to keep something for long; to activate it without review, each clause must, and nothing may be quoted or conditional."""
    said = stripped(unquoted(text))
    hypothetical = has(said, r"[?？]") | has(said, r"示例|转述|引用|别人说|\b(?:example|quote)\b")
    asks = lambda c: has(c, P.RETENTION_REQUEST) & (has(c, P.RETENTION_HORIZON) | (has(c, r"正式|决策|默认|\b(?:decision|policy|default)\b") if activates else F.lit(False)))
    if not activates:
        parts = F.filter(F.transform(sentence_parts(said), stripped), lambda c: c != "")
        return ~hypothetical & F.exists(parts, asks)
    clauses = F.when(quoted_evidence(text), F.array().cast("array<string>")).otherwise(assertion_clauses(text))
    return ~hypothetical & ~has(said, P.ATTRIBUTED) & let(clauses, lambda c: (F.size(c) > 0) & F.forall(c, asks))


def admit(proposals: DataFrame) -> DataFrame:
    """Proposals (declared, role, quotes, knowledge_type, user_text, assistant_text, n_tools) with what becomes of them.

    reason (null: admitted), admitted_as, kept (the verbatim texts that are kept), category, proposed_scope, auto_accept. A proposal that mixes an intent or a passing
    remark with lasting statements keeps those statements; nothing that was cut that way is accepted without review or beyond its project.
    """
    source = F.when(F.col("role") == "user", F.col("user_text")).otherwise(F.col("assistant_text"))
    exact = F.transform("quotes", stripped)
    own = proposals.withColumns({"__source": source, "__exact": exact})
    own = own.withColumns({"__context": context(F.col("__source"), F.col("__exact")), "__text": F.array_join("__exact", "\n")})
    user = F.col("role") == "user"
    around = F.col("__context")
    rules = F.regexp_replace(around, P.RULE_ABOUT_GUESSES, "")
    category = F.when(retention(F.col("declared"), rules) != "durable", retention(F.col("declared"), rules)).when(_qualified(around), "uncertain").otherwise("durable")
    own = own.withColumns({"category": category, "__asked": user & requests_retention(F.col("__text")), "__clipped": clipped(F.col("__source"), F.col("__exact"))})
    passing = (F.col("category") != "durable") & ~F.col("__asked")
    mixed = user & (F.col("category") == "durable") & mixed_intent(F.col("__exact"))
    salvage = F.when(user & ~F.col("__clipped") & (passing | mixed), independent_assertions(F.col("declared"), F.col("__source"), F.col("__exact")))
    own = own.withColumn("__saved", F.coalesce(salvage, F.array().cast("array<string>")))
    verbatim = F.forall("quotes", lambda q: (F.char_length(F.trim(q)) >= LEAST) & F.contains(F.col("__source"), q))
    saved = F.size("__saved") > 0
    why = F.coalesce(
        F.when(~F.col("declared").isin("durable", "temporary", "uncertain"), "invalid_retention"),
        F.when(~F.size("quotes").between(1, 3), "invalid_source_quotes"),
        F.when(~F.col("role").isin("user", "assistant"), "invalid_source_role"),
        F.when(~user & ((F.col("n_tools") == 0) | has(F.col("__source"), P.SPECULATION)), "assistant_without_observed_work"),
        F.when(~verbatim, "not_verbatim"),
        F.when(has(F.col("user_text"), P.NO_SAVE), "not_authorized"),
        F.when(user & F.forall("__exact", task_only), "task_instruction_not_knowledge"),
        sensitive_reason(around),
        F.when(has(unquoted(around), P.DENY_STORAGE), "memory_storage_opt_out"),
        F.when(passing & ~saved, F.concat("category", F.lit("_knowledge"))),
        F.when(F.col("__clipped"), "uncertain_knowledge"),
    )
    cut = saved & (passing | (F.col("__saved") != F.col("__exact")))
    only = (F.size("__exact") == 1) & (F.col("__text") == stripped(F.col("user_text"))) & (F.char_length("__text") <= WHOLE)
    directive = stable_directive(F.col("user_text"))
    explicit = user & only & (F.col("category") == "durable") & F.col("knowledge_type").isin("preference", "decision") & (
        (requests_retention(F.col("user_text"), True) & has(unquoted(F.col("user_text")), P.LONG_TERM)) | directive
    ) & ~has(unquoted(F.col("user_text")), P.ATTRIBUTED) & ~has(F.col("user_text"), P.QUESTION)
    wide = user & ~cut & has(around, P.USER_SCOPE) & ~has(around, P.LOCAL_SCOPE) & ~has(around, P.QUOTED)
    judged = own.withColumn("reason", why)
    accept = F.col("reason").isNull() & ~cut & explicit
    named = (
        F.when(cut, "independent_source_assertions").when(accept, "stable_user_directive")
        .when(F.col("__asked") & (F.col("category") != "durable"), F.concat(F.lit("explicit_retention_"), "category")).otherwise("requires_review")
    )
    out = judged.withColumns({
        "admitted_as": F.when(F.col("reason").isNull(), named), "kept": F.when(F.col("reason").isNull(), F.when(cut, F.col("__saved")).otherwise(F.transform("__exact", canonical_quote))),
        "proposed_scope": F.when(wide, "user").otherwise("project"), "auto_accept": F.coalesce(accept, F.lit(False)),
    })
    return out.drop("__source", "__exact", "__context", "__text", "__asked", "__clipped", "__saved")
