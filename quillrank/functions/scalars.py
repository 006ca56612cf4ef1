"""Scalar semantics as Column builders: normal forms, parses, dates of partial precision, rules. All JVM-side, none raises on bad text unless said."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing identifier, units of amount and their size in mol/l, month prefixes.
NULL_TOKENS = ("n.a.", "na", "nan")
MOLAR = {"M": 1.0, "MM": 1e-3, "UM": 1e-6, "NM": 1e-9, "PM": 1e-12, "FM": 1e-15}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Kinds of evidence, their weights and the endpoints that lead to them.
TIERS = {"A_affinity_candidate": 1.0, "B_quantitative_functional_candidate": 0.7, "C_contextual_functional_exact": 0.35, "Q_unverified_screen_or_other_exact": 0.0, "D_censored_or_unresolved": 0.0}
AFFINITY = ("KI", "KD")
POTENCY = ("IC50", "EC50")
CONTEXT = ("INHIBITION", "ACTIVITY", "EMAX", "EFFICACY", "%INHIB (MEAN)", "%MAX (MEAN)", "RESIDUAL ACTIVITY")
SCREEN = ("AC50", "POTENCY")
# Classes of endpoints in the order in which they are tried, the class of any other, levels and roles of evidence that counts and of other.
CLASSES = {"affinity_or_inhibition_constant_candidate": AFFINITY, "quantitative_functional_potency_candidate": POTENCY, "screen_or_potency_endpoint_needs_assay_context": SCREEN, "functional_effect_needs_assay_context": CONTEXT}
OTHER_CLASS = "other_or_unclassified_endpoint"
LEVELS = ("P1_npass_raw_exact_candidate", "P0_censored_or_unresolved")
ROLES = ("weak_candidate_only", "exclude_from_positive_and_unlabeled")


def blank_to_null(c: Column) -> Column:
    trimmed = F.trim(c)
    return F.when(trimmed != "", trimmed)


def normal_token(c: Column) -> Column:
    """First of a list of identifiers, upper case; null tokens and blanks are empty."""
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(text).isin(*NULL_TOKENS), F.lit("")).otherwise(F.upper(F.split(text, r"[;,|\s]+")[0]))


def is_human_single_protein(kind: Column, tax: Column, accession: Column, kinds: tuple[str, ...] = ("individual protein", "single protein"), taxon: str = "9606") -> Column:
    return (F.replace(F.trim(tax), F.lit(".0"), F.lit("")) == taxon) & F.lower(F.trim(kind)).isin(*kinds) & (F.coalesce(accession, F.lit("")) != "")


def first_block(key: Column) -> Column:
    return F.substring_index(key, "-", 1)


def pair_key(left: Column, right: Column, fallback: Column | None = None) -> Column:
    return F.concat_ws("|", left, right if fallback is None else F.coalesce(F.nullif(right, F.lit("")), fallback))


def pair_key_fault(key: Column, left: Column, right: Column) -> Column:
    """Null where a supplied key is right, else what is wrong."""
    return F.when(left.contains("|") | right.contains("|"), F.lit("separator_in_part")).when(~key.eqNullSafe(pair_key(left, right)), F.lit("key_differs"))


_DIGITS = r"\d+(?:_\d+)*"
#: Decimal literals: a sign, digits with single underscores between, a point, an exponent. Suffixes and hexadecimal floats, which the JVM reads, aren't among them.
NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


#: White space that a pattern's \s means.
SPACES = " \t\n\x0b\f\r"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def finite(c: Column) -> Column:
    """The number a text holds between white space; null for none, NaN and infinities."""
    text = F.btrim(c, F.lit(SPACES))
    x = F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit(""))).try_cast("double")
    return _once(x, lambda v: F.when(F.abs(v) < float("inf"), v))  # NaN is above all


def normal_unit(c: Column) -> Column:
    text = F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), "µμΜ", "UUU")
    return F.replace(text, F.lit("MOLAR"), F.lit("M"))


def molar(value: Column, unit: Column) -> Column:
    factor = F.create_map(*(F.lit(x) for pair in MOLAR.items() for x in pair))
    return value * F.try_element_at(factor, normal_unit(unit))


def neg_log10(c: Column) -> Column:
    return F.when(c > 0, -F.log10(c))


def tier(relation: Column, endpoint: Column, value: Column, unit: Column) -> Column:
    """Struct of tier, weight, reason, molar and p of one measurement; an inexact relation goes before all else. The text is parsed once a row."""
    kind = F.upper(F.trim(F.coalesce(endpoint, F.lit(""))))
    a, b, c, q, d = TIERS
    exact = F.trim(F.coalesce(relation, F.lit(""))) == "="

    def named(p: Column) -> Column:
        number, m = p["number"], p["molar"]
        name = F.when(~exact | number.isNull(), d).when(kind.isin(*AFFINITY) & m.isNotNull(), a).when(kind.isin(*POTENCY) & m.isNotNull(), b).when(kind.isin(*CONTEXT), c).otherwise(q)
        weight = F.try_element_at(F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair)), name)
        reason = F.when(~exact, "non_exact_relation").when(number.isNull(), "missing_or_non_numeric_value").otherwise("exact_record")
        return F.struct(name.alias("tier"), weight.alias("weight"), reason.alias("reason"), m.alias("value_molar"), neg_log10(m).alias("p_activity"))

    return _once(_once(finite(value), lambda number: F.struct(number.alias("number"), molar(number, unit).alias("molar"))), named)


def measurement_class(endpoint: Column) -> Column:
    kind, out = F.upper(F.trim(F.coalesce(endpoint, F.lit("")))), F.lit(OTHER_CLASS)
    for name, endpoints in reversed(CLASSES.items()):
        out = F.when(kind.isin(*endpoints), name).otherwise(out)
    return out


def verification(name: Column) -> Column:
    """Struct of level, reviewed, role, promoted; nothing is ever reviewed or promoted by rule."""
    good = name.isin(*list(TIERS)[:3])
    either = lambda pair: F.when(good, pair[0]).otherwise(pair[1])
    return F.struct(either(LEVELS).alias("level"), F.lit(False).alias("reviewed"), either(ROLES).alias("role"), F.lit(False).alias("promoted"))


def partial_date(c: Column) -> Column:
    """Struct of value (as precise as the text) and precision: day, month, year, missing or unparseable.

    The month is a word after the year, the day a number after the month; a day that the month lacks is no day. Each
    pattern is matched once a row.
    """
    text = F.trim(F.coalesce(c, F.lit("")))
    found = lambda t, pattern: F.nullif(F.regexp_extract(t, pattern, 1), F.lit(""))

    def parted(t: Column) -> Column:
        return F.struct(t.alias("text"), found(t, r"\b((?:19|20)\d{2})\b").alias("year"), F.regexp_extract(t, r"\b(?:19|20)\d{2}\b(.*)$", 1).alias("rest"))

    def named(p: Column) -> Column:
        word = F.lower(F.substring(F.regexp_extract(p["rest"], r"\b([A-Za-z]{3,9})\b", 1), 1, 3))
        month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), word), F.lit(0))
        day = found(F.regexp_extract(p["rest"], r"\b[A-Za-z]{3,9}\b(.*)$", 1), r"\b([0-2]?\d|3[01])\b")
        return F.struct(p["text"].alias("text"), p["year"].alias("year"), F.concat_ws("-", p["year"], F.lpad(month.cast("string"), 2, "0")).alias("to_month"), month.isNotNull().alias("has_month"), day.alias("day"))

    def whole(p: Column) -> Column:
        return F.struct(p["text"].alias("text"), p["year"].alias("year"), p["to_month"].alias("to_month"), p["has_month"].alias("has_month"), F.when(p["has_month"] & p["day"].isNotNull(), F.try_to_date(F.concat_ws("-", p["to_month"], F.lpad(p["day"], 2, "0")), "yyyy-MM-dd")).alias("whole"))

    def result(p: Column) -> Column:
        case = lambda d, m, y, none, bad: F.when(p["text"] == "", none).when(p["year"].isNull(), bad).when(~p["has_month"], y).when(p["whole"].isNull(), m).otherwise(d)
        value = case(F.date_format(p["whole"], "yyyy-MM-dd"), p["to_month"], p["year"], F.lit(""), F.lit(""))
        return F.struct(value.alias("value"), case(*map(F.lit, ("day", "month", "year", "missing", "unparseable"))).alias("precision"))

    return _once(_once(_once(_once(text, parted), named), whole), result)


def first_usable_date(sources: dict[str, Column]) -> Column:
    """Struct of value, precision and source: of the first text that holds a year at least."""
    out = F.struct(F.lit("").alias("value"), F.lit("missing").alias("precision"), F.lit("").alias("source"))
    for name, c in reversed(sources.items()):
        d = partial_date(c)
        out = F.when(d["precision"].isin("day", "month", "year"), F.struct(d["value"].alias("value"), d["precision"].alias("precision"), F.lit(name).alias("source"))).otherwise(out)
    return out


def bounds(value: Column, precision: Column) -> Column:
    """Struct of lo and hi, the first and last day that a date of partial precision may mean; nulls where it means none."""
    start = F.when(precision == "day", F.try_to_date(value, "yyyy-MM-dd")).when(precision == "month", F.try_to_date(F.concat(value, F.lit("-01")), "yyyy-MM-dd")).when(precision == "year", F.try_to_date(F.concat(value, F.lit("-01-01")), "yyyy-MM-dd"))
    end = F.when(precision == "day", start).when(precision == "month", F.last_day(start)).when(precision == "year", F.add_months(start, 12) - F.expr("INTERVAL 1 DAY"))
    return F.struct(start.alias("lo"), end.cast("date").alias("hi"))


def interval_status(lo: Column, hi: Column, cutoff: Column) -> Column:
    return F.when(lo.isNull() | hi.isNull(), "unresolved").when(hi <= cutoff, "definitely_before_or_on_cutoff").when(lo > cutoff, "definitely_after_cutoff").otherwise("crossing_cutoff")


def policies(precision: Column, lo: Column, hi: Column, cutoff: Column) -> dict[str, Column]:
    """Eligibility under each date policy."""
    sure = F.coalesce(hi <= cutoff, F.lit(False))
    return {"day_precise_only": (precision == "day") & sure, "interval_certain": sure, "interval_earliest_bound": F.coalesce(lo <= cutoff, F.lit(False))}


def boolean_text(c: Column, dialect: str) -> Column:
    """Booleans in text. strict: true, 1, yes, false, 0, no; blank_false: these and blank; words: true and false alone. Null for any other text."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    yes, no = {"strict": (("true", "1", "yes"), ("false", "0", "no")), "blank_false": (("true", "1", "yes"), ("false", "0", "no", "")), "words": (("true",), ("false",))}[dialect]
    return F.when(x.isin(*yes), True).when(x.isin(*no), False)


def required_boolean(c: Column, dialect: str) -> Column:
    """The same, but text that is no boolean fails the query."""
    parsed = boolean_text(c, dialect)
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(c, F.lit("null")))).cast("boolean"))


def threshold_text(value: float | str) -> str:
    """An identity threshold with two decimals, in (0, 1]."""
    x = float(value)
    if not 0 < x <= 1:
        raise ValueError(f"threshold {value} is not in (0, 1]")
    return f"{x:.2f}"


def list_count(c: Column, sep: str = ";") -> Column:
    """Distinct entries of a joined list that aren't blank."""
    return F.size(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != ""))).cast("long")


def joined(c: Column, sep: str = ";") -> Column:
    """Aggregate: distinct entries that aren't blank, in order."""
    return F.array_join(F.array_sort(F.collect_set(blank_to_null(c))), sep)


def bit_overlap(a: Column, b: Column) -> Column:
    """Tanimoto similarity of two bit sets given as arrays of 64-bit words; 0 for two empty sets."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def salted(salt: str, *parts: Column) -> Column:
    """Ties are ordered by this text: fixed width, so text order is the order of the first 64 bits."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256), 1, 16)


def derived_seed(base: int, *labels: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, (base, *labels))).encode()).digest()[:8], "big")


def derived_seed_text(base: int, *labels: Column) -> Column:
    """The same seed by row, as 16 hexadecimal digits."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(base)), *labels), 256), 1, 16)


def threshold_of(c: Column) -> Column:
    """An identity threshold with two decimals by row, null outside (0, 1]."""
    x = finite(c)
    return F.when((x > 0) & (x <= 1), F.format_string("%.2f", x))


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def sequence_text(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def assay_context(code: Column) -> Column:
    x = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return F.when(x == "B", "binding_assay_candidate").when(x == "F", "functional_assay_candidate").otherwise("other_assay_context")


def prefixed(columns: list[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in columns]


def optional(columns: list[str], name: str, kind: str = "string") -> Column:
    return F.col(name) if name in columns else F.lit(None).cast(kind).alias(name)


def unit_interval(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def relative_change(new: Column, old: Column) -> Column:
    """Struct of change and status; a change from 0 has no relative size."""
    return F.struct(F.when(old != 0, (new - old) / old).alias("change"), F.when(old != 0, "estimated").otherwise("undefined_zero_reference").alias("status"))


def direction(delta: Column) -> Column:
    return F.when(delta > 0, "increase").when(delta < 0, "decrease").otherwise("no_change")
