"""PASS / FAIL / FLAG gates with quoted evidence.

Reading the text is the expensive part and depends on the posting alone, so
:func:`with_text_facts` runs the patterns once per posting; the gates then
compare those facts with a candidate. Pairing a posting with many candidates
never re-reads its text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolebook import vocab
from rolebook.functions.dates import age_days
from rolebook.functions.money import plain_number
from rolebook.functions.text import canon_location, col_of, has_text

_LANGS = "|".join(vocab.GATED_LANGUAGES)
_TERM = vocab.BATCH_TERM
_GAP = r"[^.;!?|\n]{0,30}?"
# (?<!\w) and (?!\w) are ASCII word boundaries, which Java's \b is not. Patterns
# without (?i) are for lowercased text: they run much faster that way.
NEAR_BATCH = (
    rf"(?<!\w)20\d{{2}}(?!\w){_GAP}(?<!\w)(?:{_TERM})(?!\w)"
    rf"|(?<!\w)(?:{_TERM})(?!\w){_GAP}(?<!\w)20\d{{2}}(?!\w)"
)
ONLY_WORD = rf"(?<!\w)(?:{vocab.BATCH_ONLY})(?!\w)"
MONTHLY = vocab.MONTHLY_PATTERN
LAKHS = vocab.LAKHS_PATTERN
ANNUAL = vocab.ANNUAL_PATTERN
BOND = "(?i)" + vocab.BOND_PHRASE
FLUENT = vocab.FLUENT_PATTERN
FLUENT_STRICT = vocab.FLUENT_STRICT_PATTERN
REQUIRED = rf"(?i)(?:{_LANGS})\s*(?:{vocab.REQUIRED_WORDS})"


@dataclass(frozen=True)
class Gate:
    """One gate as ordered branches (condition, verdict, note).

    ``verdict`` alone is a CASE over literals, so a filter on it never builds
    notes; ``result`` is the struct(gate, verdict, note) with the evidence.
    """

    name: str
    branches: tuple[tuple[Column, str, object], ...]

    def _case(self, pick) -> Column:
        out = pick("PASS", "")
        for condition, verdict, note in reversed(self.branches):
            out = F.when(condition, pick(verdict, note)).otherwise(out)
        return out

    @cached_property
    def verdict(self) -> Column:
        return self._case(lambda verdict, _: F.lit(verdict))

    @property
    def note(self) -> Column:
        return self._case(lambda _, note: F.lit(note))

    @property
    def fails(self) -> Column:
        return self.verdict == "FAIL"

    @property
    def result(self) -> Column:
        return F.struct(F.lit(self.name).alias("gate"), self.verdict.alias("verdict"), self.note.alias("note"))


def _quote(text: Column, pattern: str) -> Column:
    got = F.regexp_extract(text, pattern, 0)
    return F.when(got != "", got)


def _mentions(low: Column, *words: str) -> Column:
    """Whether any of the words occurs at all in a lowercased text. A plain
    byte search, so most texts never reach the patterns."""
    out = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def language_quote(text: Column, low: Column, strict: bool = False) -> Column:
    """Quoted non-English requirement, or NULL.

    ``fluent in X`` reads X as the language; ``strict`` reads the very next
    word instead, which turns "fluent in English" into a finding.
    """
    fluent = FLUENT_STRICT if strict else FLUENT
    spoken = F.lower(F.regexp_extract(text, fluent, 1))
    first = F.when((spoken != "") & (spoken != "english"), F.regexp_extract(text, fluent, 0))
    return F.coalesce(
        F.when(_mentions(low, "fluent"), first),
        F.when(_mentions(low, "required", "must", "essential"), _quote(text, REQUIRED)),
    )


def batch_mentions(low: Column) -> Column:
    """Array of (years, only) from a lowercased text: the sentences naming a
    year beside a batch word.

    ``only`` needs an only-word in the same sentence, no later than the line
    of the last mention.
    """
    def read(sentence):
        spans = F.regexp_extract_all(sentence, F.lit(NEAR_BATCH), F.lit(0))
        years = F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(r"(?<!\w)20\d{2}(?!\w)"), F.lit(0))))
        lines = F.split(sentence, "\n")
        mentions = F.transform(lines, lambda s: s.rlike(NEAR_BATCH))
        last = F.size(lines) - F.coalesce(F.array_position(F.reverse(mentions), True), F.lit(0)) + 1
        upto = F.array_join(F.slice(lines, 1, F.greatest(last, F.lit(0)).cast("int")), "\n")
        only = F.exists(mentions, lambda m: m) & upto.rlike(ONLY_WORD)
        return F.struct(years.cast("array<int>").alias("years"), only.alias("only"))

    worded = _mentions(low, "batch", "graduat", "pass", "class", "cohort", "fresher")
    sentences = F.filter(
        F.regexp_extract_all(low, F.lit("[^.;!?]+"), F.lit(0)),
        lambda s: F.contains(s, F.lit("20")) & s.rlike(NEAR_BATCH),
    )
    none = F.array().cast("array<struct<years:array<int>,only:boolean>>")
    return F.when(F.contains(low, F.lit("20")) & worded, F.transform(sentences, read)).otherwise(none)


def batch_years(facts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(facts["batch"]["years"])))


def batch_exclusive(facts: Column) -> Column:
    return F.exists(facts["batch"], lambda m: m["only"])


def first_money(low: Column, unit: str, *hints: str) -> Column:
    """First amount tied to the unit in a lowercased text; the four readings
    are tried in order. Every text with the unit contains one of ``hints``."""
    amount, after = vocab.AMOUNT, vocab.CURRENCY_AFTER_UNIT
    readings = (
        rf"{vocab.CURRENCY_BEFORE_AMOUNT}{amount}\s*(?:{unit})",
        rf"(?:{unit})\s*{vocab.MONEY_JOINERS}{after}?{amount}",
        rf"(?:{unit}){vocab.MONEY_GAP}{after}{amount}",
        rf"(?:{unit}){vocab.MONEY_GAP}(?<!\w)of\s+{after}?{amount}",
    )
    values = [F.translate(F.regexp_extract(low, r, 1), ",", "").try_cast("double") for r in readings]
    worth = _mentions(low, *hints) & low.rlike("[0-9]") & low.rlike(unit)
    return F.when(worth, F.coalesce(*values))


def bond_quote(text: Column, low: Column) -> Column:
    """Bond terms as one line that is safe inside a pipe table."""
    line = F.regexp_replace(_quote(text, BOND), r"[\r\n]+", " ")
    safe = F.trim(F.replace(line, F.lit("|"), F.lit("\\|")))
    return F.when(_mentions(low, "bond", "service agreement"), safe)


def text_facts(description, low=None, strict: bool = False) -> Column:
    """Struct of what the text gates need; ``low`` is the lowercased text."""
    t = col_of(description)
    low = F.lower(t) if low is None else low
    lakhs = first_money(low, LAKHS, "lpa", "lakh")
    rupees = first_money(low, ANNUAL, "annum", "annually", "yr")
    return F.struct(
        has_text(t).alias("has_text"),
        language_quote(t, low, strict).alias("language"),
        batch_mentions(low).alias("batch"),
        first_money(low, MONTHLY, "mo").alias("monthly"),
        F.coalesce(lakhs, rupees / F.lit(100000.0)).alias("lpa"),
        bond_quote(t, low).alias("bond"),
    )


def with_text_facts(df: DataFrame, column: str = "description", strict: bool = False) -> DataFrame:
    """Adds ``facts`` (and ``place``): everything the gates need to know of a
    posting, read once.

    The one-element ``explode`` keeps Catalyst from inlining the patterns into
    every gate and every filter on a gate, which would read each text again.
    """
    facts = text_facts(F.col(column), F.col("_low"), strict)
    read = df.withColumn("_low", F.lower(column)).select("*", F.explode(F.array(facts)).alias("facts")).drop("_low")
    return read.withColumn("place", canon_location("location"))


def without_text(df: DataFrame) -> DataFrame:
    """Facts of a pass that carries no description: every text gate reports
    "not evaluated" instead of inventing a finding."""
    nothing = F.struct(
        F.lit(False).alias("has_text"),
        F.lit(None).cast("string").alias("language"),
        F.array().cast("array<struct<years:array<int>,only:boolean>>").alias("batch"),
        F.lit(None).cast("double").alias("monthly"),
        F.lit(None).cast("double").alias("lpa"),
        F.lit(None).cast("string").alias("bond"),
    )
    return df.withColumns({"facts": nothing, "place": canon_location("location")})


def _text_gate(name: str, facts: Column, *branches, applies: Column | None = None) -> Gate:
    """A gate that passes where it does not apply or there is no text."""
    silent = [(~facts["has_text"], "PASS", vocab.NOT_EVALUATED_NOTE)]
    if applies is not None:
        silent.insert(0, (~applies, "PASS", ""))
    return Gate(name, (*silent, *branches))


def gate_stale(posted, max_age_days, as_of) -> Gate:
    age = age_days(posted, as_of)
    limit = F.lit(max_age_days) if isinstance(max_age_days, int) else max_age_days
    note = F.concat(F.lit("posted "), age, F.lit("d ago (> "), limit, F.lit("d window)"))
    return Gate(
        "stale",
        ((age.isNull(), "FLAG", "no posting date; freshness unknown"), (age > limit, "FAIL", note)),
    )


def gate_location(location, place, cand: Column) -> Gate:
    """``place`` is the canonical location, ``cand.accept`` the canonical
    accepted places; an empty list accepts anywhere."""
    loc = col_of(location)
    accepted = F.exists(cand["accept"], lambda w: F.contains(place, w))
    outside = F.concat(F.lit('location "'), loc, F.lit('" outside accepted set'))
    return Gate(
        "location",
        (
            (F.size(cand["accept"]) == 0, "PASS", ""),
            (loc.isNull(), "FAIL", "location unstated (source gave none)"),
            (~accepted, "FAIL", outside),
        ),
    )


def gate_language(facts: Column) -> Gate:
    note = F.concat(F.lit('requires working language: "'), facts["language"], F.lit('"'))
    return _text_gate("language", facts, (facts["language"].isNotNull(), "FAIL", note))


def gate_batch(facts: Column, cand: Column) -> Gate:
    years = batch_years(facts)
    mine = F.concat(F.array_join(years, "/"), F.lit(" (candidate: "), cand["grad_year"], F.lit(")"))
    fits = (F.size(years) == 0) | F.array_contains(years, cand["grad_year"])
    return _text_gate(
        "batch", facts,
        (fits, "PASS", ""),
        (batch_exclusive(facts), "FAIL", F.concat(F.lit("batch-restricted to "), mine)),
        (F.lit(True), "FLAG", F.concat(F.lit("mentions batches "), mine)),
        applies=cand["stage"].isin("student", "fresher") & F.coalesce(cand["grad_year"] != 0, F.lit(False)),
    )


def gate_stipend(facts: Column, cand: Column) -> Gate:
    floor, paid = cand["stipend_floor"], facts["monthly"]
    note = F.concat(F.lit("stipend "), plain_number(paid), F.lit(" < floor "), plain_number(floor), F.lit("/month"))
    return _text_gate(
        "stipend", facts,
        (paid.isNull(), "FLAG", "no stipend stated"),
        (paid < floor, "FAIL", note),
        applies=(cand["stage"] == "student") & F.coalesce(floor != 0, F.lit(False)),
    )


def one_decimal(x: Column) -> Column:
    """A non-negative double with one decimal: the nearer of the two neighbours by its
    exact binary value (1.15 is a little less, so 1.1), a true tie upwards."""
    tenths = F.floor(x * 10).cast("double")
    wide = x * 134217729.0
    high = wide - (wide - x)
    # 10 * x less the middle, without rounding: both halves of x times ten are exact
    over = (high * 10 - (tenths + 0.5)) + (x - high) * 10
    n = F.when(over >= 0, tenths + 1).otherwise(tenths).cast("bigint")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def gate_ctc(facts: Column, cand: Column) -> Gate:
    """Below-floor pay only ever flags."""
    floor, paid = cand["ctc_floor"], facts["lpa"]
    shown = one_decimal(paid)
    note = F.concat(F.lit("CTC ~"), shown, F.lit(" LPA < floor "), plain_number(floor), F.lit(" LPA"))
    return _text_gate(
        "ctc", facts,
        (paid.isNull(), "FLAG", "no CTC stated"),
        (paid < floor, "FLAG", note),
        applies=F.coalesce(floor != 0, F.lit(False)),
    )


def gate_bond(facts: Column) -> Gate:
    note = F.concat(F.lit('bond terms: "'), facts["bond"], F.lit('"'))
    return _text_gate("bond", facts, (facts["bond"].isNotNull(), "FLAG", note))


def all_gates(cand: Column, as_of, max_age_days=vocab.RANK_MAX_AGE_DAYS) -> list[Gate]:
    """The seven gates in order, over ``facts`` and ``place``."""
    facts = F.col("facts")
    return [
        gate_stale("posted_date", max_age_days, as_of),
        gate_location("location", F.col("place"), cand),
        gate_language(facts),
        gate_batch(facts, cand),
        gate_stipend(facts, cand),
        gate_ctc(facts, cand),
        gate_bond(facts),
    ]


def run_gates(df: DataFrame, cand: Column, as_of, max_age_days=vocab.RANK_MAX_AGE_DAYS) -> DataFrame:
    """Adds ``gates`` (seven results in order) and ``pass`` (no FAIL).

    ``pass`` reads the verdicts only, so a plan that just counts or filters
    on it never builds the results. ``df`` needs :func:`with_text_facts` or
    :func:`without_text`.
    """
    found = all_gates(cand, as_of, max_age_days)
    failed = found[0].fails
    for g in found[1:]:
        failed = failed | g.fails
    return df.withColumns({"gates": F.array(*[g.result for g in found]), "pass": ~failed})


def running_gates(stage: Column, market: Column) -> Column:
    """Canonical gates that run for a stage and market, in policy order."""
    def scope(values, c):
        return F.lit(True) if "*" in values else c.isin(*values)

    names = [F.when(scope(stages, stage) & scope(markets, market), F.lit(name)) for name, stages, markets, _, _ in vocab.GATE_POLICY]
    return F.array_compact(F.array(*names))


def gate_runs_for(gate_id: Column, stage: Column, market: Column) -> Column:
    """Whether the canonical policy runs a gate; unknown gates never run."""
    return F.array_contains(running_gates(stage, market), gate_id)


def policy_map() -> Column:
    """gate -> struct(verdict_on_fail, hard_stop)."""
    entries = []
    for name, _, _, verdict, hard in vocab.GATE_POLICY:
        entries += [F.lit(name), F.struct(F.lit(verdict).alias("verdict_on_fail"), F.lit(hard).alias("hard_stop"))]
    return F.create_map(*entries)


def canonical_gate(name: Column) -> Column:
    """One spelling per gate: aliases of a gate count as that gate."""
    slug = F.lower(F.trim(name))
    pairs = [F.lit(v) for pair in vocab.GATE_ALIASES.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), slug), slug)


def apply_gate_policy(df: DataFrame, stage: Column, market: Column) -> DataFrame:
    """Canonical gates: keeps results whose gate runs for the stage and market
    and gives a failed gate the policy's verdict. Adds ``policy_gates``,
    ``policy_pass`` and ``hard_stop``. Verdicts of gates without rule text
    (eligibility, notice-period, timezone-overlap) come in with the input.

    A FLAG is never raised to a FAIL by the policy.
    """
    named = F.transform(
        "gates", lambda g: F.struct(canonical_gate(g["gate"]).alias("gate"), g["verdict"].alias("verdict"), g["note"].alias("note"))
    )

    def judged(g):
        policy = F.element_at(policy_map(), g["gate"])
        verdict = F.when(g["verdict"] == "FAIL", policy["verdict_on_fail"]).otherwise(g["verdict"])
        return F.struct(
            g["gate"].alias("gate"), verdict.alias("verdict"), g["note"].alias("note"),
            (policy["hard_stop"] & (g["verdict"] == "FAIL")).alias("hard_stop"),
        )

    out = df.withColumns({"policy_gates": named, "_running": running_gates(stage, market)})
    kept = F.filter("policy_gates", lambda g: F.array_contains(F.col("_running"), g["gate"]))
    out = out.withColumn("policy_gates", F.transform(kept, judged)).drop("_running")
    return out.withColumns(
        {
            "policy_pass": F.forall("policy_gates", lambda g: g["verdict"] != "FAIL"),
            "hard_stop": F.exists("policy_gates", lambda g: g["hard_stop"]),
        }
    )


def with_external_gates(df: DataFrame, external: Column) -> DataFrame:
    """Append verdicts decided elsewhere: an array of (gate, verdict, note)."""
    return df.withColumn("gates", F.concat("gates", external))


def staleness_flag(posted, as_of, days: int = vocab.STALE_DAYS) -> Column:
    """Visible age flag that never vetoes; undated postings get none."""
    age = age_days(posted, as_of)
    return F.when(age > days, F.concat(F.lit("posted "), age, F.lit(" days ago")))
