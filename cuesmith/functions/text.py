"""Words, sentence ends, reading speed, hashes."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "rev", "fr", "sr", "jr", "st", "messrs", "mmes", "mlle", "mt", "ave", "blvd", "rd", "ln", "ste", "apt", "dept", "fl",
    "inc", "ltd", "co", "corp", "llc", "plc", "vs", "etc", "no", "al", "approx", "est", "min", "max", "jan", "feb", "mar", "apr", "jun", "jul", "aug",
    "sep", "sept", "oct", "nov", "dec", "mon", "tue", "wed", "thu", "fri", "sat", "sun",
)
CLOSING = "[.!?\"')\\]}»”’]"
CJK_ENDS = "。！？．"
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193
# ----


def is_sentence_end(word: Column) -> Column:
    """Whether a word closes a sentence: abbreviations, initials and ellipses do not."""
    w = F.regexp_replace(word, r"^\s+|\s+$", "")
    bare = F.trim(F.regexp_replace(w, CLOSING + "+$", ""))
    dotted = w.endswith(".") & (F.contains(bare, F.lit(".")) | F.lower(bare).isin(*ABBREVIATIONS) | bare.rlike("^[A-Z]$"))
    ends = w.rlike("[.!?]$") & ~w.endswith("...") & ~dotted
    return F.coalesce(w.rlike(f"[{CJK_ENDS}]$") | ends, F.lit(False))


def is_sound(text: Column) -> Column:
    t = F.trim(text)
    return t.startswith("[") & t.endswith("]")


def visible_chars(text: Column, measure: str = "characters") -> Column:
    """Length as ``characters``, ``characters_no_spaces`` or ``words``."""
    if measure == "words":
        return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.length(F.regexp_replace(text, r"\s+", "") if measure == "characters_no_spaces" else text)


def cps(chars: Column, start: Column, end: Column) -> Column:
    return chars / (F.greatest(F.lit(1), end - start) / 1000.0)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "</?[bi]>", "")


def canonical_sha256(json: Column) -> Column:
    """Versioned digest of a canonical JSON string."""
    return F.sha2(F.concat(F.lit("cchash/v1\n"), json), 256)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, eight hexadecimal digits."""
    signs = F.filter(F.split(text, ""), lambda s: s != "")
    step = lambda h, s: (h.bitwiseXOR(F.ascii(s).cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.lpad(F.lower(F.hex(F.aggregate(signs, F.lit(FNV_OFFSET).cast("long"), step))), 8, "0")


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    return int(value) if isinstance(value, float) and value.is_integer() else value


def _no_number(name: str):
    raise ValueError(f"{name} has no canonical form")


def canonical(text: str) -> str:
    """JSON text in canonical form."""
    value = _plain(json.loads(text, parse_constant=_no_number))
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_json(value: Column) -> Column:
    """JSON of a struct as it is hashed: keys sorted, no blanks, nulls kept, whole floats as
    integers, strings in composed form (which has no built-in, so this runs on Arrow batches)."""

    @F.arrow_udf("string")
    def form(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else canonical(x) for x in column.to_pylist()], pa.string())

    return form(F.to_json(value, {"ignoreNullFields": "false"}))


def export_action_key(**fields: Column) -> Column:
    """Idempotency key of an export: identity fields as strings, free ones trimmed and lower-cased, distinct sorted codes."""
    text = lambda n: F.coalesce(fields[n].cast("string"), F.lit(""))
    folded = lambda n: F.lower(F.trim(text(n)))
    plain = {n: text(n) for n in ("project_id", "format_run_id", "spec_slug", "actor_id")}
    plain |= {n: folded(n) for n in ("format", "override_reason", "actor_email")} | {"client_action_id": F.trim(text("client_action_id"))}
    codes = F.array_sort(F.array_distinct(F.coalesce(fields["issue_codes"], F.array().cast("array<string>"))))
    plain |= {"schema": F.lit("ccexp"), "v": F.lit(1), "spec_version": F.coalesce(fields["spec_version"].cast("long"), F.lit(0)), "override": F.coalesce(fields["override"], F.lit(False)), "issue_codes": codes}
    return F.concat(F.lit("ccexp:"), canonical_sha256(canonical_json(F.struct(*[plain[n].alias(n) for n in sorted(plain)]))))
