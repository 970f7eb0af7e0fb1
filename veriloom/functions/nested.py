"""Functions over nested manifests: label-keyed assertions, attributes, validation codes. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bytes_hex, c, instance_hash, is_trusted_issuer, or_else

ACTION_LABELS = ("c2pa.actions", "c2pa.actions.v2")
# The enabled hash rule: issuer text, labels of the assertions that hold the hash, and whether the issuer is trusted.
HASH_SPECS = [{"id": "google-pixel", "matcher": "Google LLC", "labels": ["c2pa.hash.data.part", "c2pa.hash.data"], "trusted": True}]


def first_where(items: Column | str, test) -> Column:
    """The first element that passes, in order; null if none."""
    return F.get(F.filter(c(items), test), F.lit(0))


def attribute(attributes: Column | str, trait: str) -> Column:
    """The value of the first attribute of this kind."""
    return first_where(attributes, lambda a: a["trait_type"] == trait)["value"]


def count_prefix(keys: Column | str, prefix: str) -> Column:
    return F.size(F.filter(c(keys), lambda k: k.startswith(prefix)))


def is_valid(codes: Column | str) -> Column:
    """No code starts with failure; a missing list counts as valid."""
    return F.coalesce(~F.exists(c(codes), lambda s: F.coalesce(s["code"].startswith("failure"), F.lit(False))), F.lit(True))


def errors(codes: Column | str) -> Column:
    """Explanations, or else codes, of the failures."""
    failed = F.filter(c(codes), lambda s: s["code"].startswith("failure"))
    return F.coalesce(F.transform(failed, lambda s: or_else(s["explanation"], s["code"])), F.array().cast("array<string>"))


def first_action_type(assertions: Column | str) -> Column:
    """digitalSourceType of the first action that has one, in the first actions assertion."""
    actions = first_where(assertions, lambda a: a["label"].isin(*ACTION_LABELS))["actions"]
    return first_where(actions, lambda a: F.coalesce(a["digitalSourceType"] != "", F.lit(False)))["digitalSourceType"]


def ingredients_flat(ingredients: Column | str) -> Column:
    return F.transform(c(ingredients), lambda i: F.struct(i["title"].alias("title"), i["format"].alias("format")))


def empty_as_null(items: Column | str, fields: list[str]) -> Column:
    """The structs with empty strings as null."""
    return F.transform(c(items), lambda x: F.struct(*[or_else(x[f]).alias(f) for f in fields]))


def content_hash(issuer: Column | str, assertions: Column | str, instance_id: Column | str, specs: list[dict] | None = None) -> Column:
    """The content hash under the first spec whose matcher the issuer holds.

    assertions: array of (label, hash, val, data), arrays of bytes. The first assertion, in order, with one of the
    spec's labels gives its hash, else val, else data; if that is empty or there is none, the instance id stands in
    for trusted issuers. Null without a spec.
    """
    specs = HASH_SPECS if specs is None else specs
    trusted = is_trusted_issuer(issuer, [s["matcher"] for s in specs])

    def with_label(labels: list[str]) -> Column:
        return first_where(assertions, lambda a: a["label"].isin(labels))

    out = None
    for spec in specs:
        found = with_label(spec["labels"])
        raw = F.coalesce(found["hash"], found["val"], found["data"])
        value = F.coalesce(or_else(bytes_hex(raw)), F.when(F.lit(spec["trusted"]) | trusted, instance_hash(instance_id)))
        match = F.coalesce(F.contains(c(issuer), F.lit(spec["matcher"])), F.lit(False))
        out = F.when(match, value) if out is None else out.when(match, value)
    return out if out is not None else F.lit(None).cast("string")


# JSON by text: a number; the key "hash" with its numbers; a string; an array of numbers. Possessive, so long texts don't recurse.
_NUMBER = r"-?+[0-9]++(?:[.][0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
_NUMBERS = rf"{_NUMBER}(?:\s*+,\s*+{_NUMBER})*+"
_TOKEN = rf'"hash"\s*+:\s*+\[\s*+(?:{_NUMBERS})?+\s*+\]|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\[\s*+{_NUMBERS}\s*+\]'


def _hex_digits(number: Column) -> Column:
    whole = number.cast("double").cast("long")
    digits = F.lower(F.hex(F.abs(whole)))
    return F.when(whole < 0, F.concat(F.lit("-"), digits)).when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)


def _token_as_hex(token: Column) -> Column:
    numbers = F.regexp_extract_all(token, F.lit(rf"(?<![0-9.eE+-]){_NUMBER}"), F.lit(0))
    text = F.concat(F.lit('"0x'), F.array_join(F.transform(numbers, _hex_digits), ""), F.lit('"'))
    are_bytes = F.forall(numbers, lambda n: n.cast("double").between(0, 255))
    is_hash = token.startswith('"hash"') & token.endswith("]")
    return F.when(is_hash, F.concat(F.substring_index(token, "[", 1), text)).when(token.startswith("[") & are_bytes, text).otherwise(token)


def byte_arrays_as_hex(texts: Column | str) -> Column:
    """JSON with every array of bytes, at any depth, and every array of numbers named hash, as 0x and hex; all else stays as it is written.

    The text is read from left to right as strings, arrays of numbers and the rest, so depth costs nothing and no Python
    runs. Text that isn't JSON (or that parse_json refuses) stays, null stays null; numbers lose their fraction.
    """
    t = c(texts)
    gaps, tokens = F.split(t, _TOKEN, -1), F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))
    out = F.array_join(F.zip_with(gaps, tokens, lambda g, x: F.concat(g, F.coalesce(_token_as_hex(x), F.lit("")))), "")
    return F.when(F.try_parse_json(t).isNull(), t).otherwise(out)
