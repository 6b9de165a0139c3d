"""Audit of planner outputs: cleaning, parsing, repairing and strict validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Action words of the runtime rule and its defaults.
RUNTIME_TYPES = (
    "buscar_google", "abrir_url", "mirar_youtube", "revisar_correo", "ver_streaming", "usar_twitter",
)
DEFAULT_TERMS = ("últimas noticias de IA", "tendencias ciberseguridad 2025", "python asyncio tutorial")
DEFAULT_SEARCHES = ("noticias tecnología", "ciberseguridad", "tutorial python")
DEFAULT_URL = "https://www.bbc.com/mundo"
DELAY_DEFAULTS = (10, 11, 12)
DELAY_RANGE = (8, 25)
# The published action schema.
SCHEMA_TYPES = ("search_google", "open_url", "watch_youtube", "show_email", "play_streaming", "use_twitter")
SCHEMA_FIELDS = ("type", "delay", "term", "url", "search")
SCHEMA_DELAY = (0, 25)
SCHEMA_LENGTH = (1, 120)


# Marks of a code fence, and a comma before a closing sign.
FENCE = r"(?i)^```(?:json)?\s*|\s*```$"
TRAILING_COMMA = r",\s*([}\]])"


def clean_output(text: Column) -> Column:
    """Drop code fences, anything outside the outer braces, and trailing commas."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    bare = F.regexp_replace(bare, FENCE, "")
    start = F.instr(bare, "{")
    end = F.char_length(bare) - F.instr(F.reverse(bare), "}") + 1
    has = (start > 0) & (F.instr(bare, "}") > 0)
    # the last closing brace may stand before the first opening one
    inner = F.when(end >= start, F.substring(bare, start, end - start + 1)).otherwise("")
    cut = F.when(has, inner).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(cut, TRAILING_COMMA, "$1"), r"^\s+|\s+$", "")


def one_value(text: Column) -> Column:
    """The JSON value that the text is as a whole, else null.

    The parser stops behind the first value. Inside brackets and as a member the text
    must be followed by the closing sign, so anything behind the value shows. Of a key
    that an object has several times the last value holds.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    value = F.try_variant_get(listed, "$[0]", "variant")
    single = F.try_variant_get(listed, "$[1]", "variant").isNull() & value.isNotNull()
    return F.coalesce(F.when(single & member.isNotNull(), value), _last_values(text))


def _last_values(text: Column) -> Column:
    """An object with repeated keys, which the strict parser refuses; null for any other text."""
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string, variant>>", strict)
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v map<string, variant>", strict)["v"]
    pairs = F.map_entries(F.get(listed, F.lit(0)))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"]))
    whole = (F.size(listed) == 1) & member.isNotNull() & (F.size(pairs) > 0)
    return F.when(whole, F.to_variant_object(F.map_from_entries(last)))


def parsed_text(cleaned: Column) -> Column:
    """The text when it is JSON, else with single quotes turned double, else null."""
    swapped = F.replace(cleaned, F.lit("'"), F.lit('"'))
    return F.when(one_value(cleaned).isNotNull(), cleaned).when(one_value(swapped).isNotNull(), swapped)


def _pick(values: tuple, seed: Column) -> Column:
    place = F.char_length(seed) % len(values)
    return F.element_at(F.array(*map(F.lit, values)), place + 1)


def _json_kind(doc: Column, field: str) -> Column:
    """Type word of a field, or null when it is absent."""
    return F.schema_of_variant(F.try_variant_get(doc, f"$.{field}", "variant"))


def _json_text(doc: Column, field: str) -> Column:
    return F.try_variant_get(doc, f"$.{field}", "string")


def repaired(parsed: DataFrame, doc_text: str = "parsed", seed: str = "raw") -> DataFrame:
    """Apply the runtime rule; ``action_type`` is null for a rejected output.

    Where the rule draws a random default, the length of the raw text picks it.
    """
    doc = one_value(F.col(doc_text))
    base = parsed.withColumn("_doc", doc)
    d = F.col("_doc")
    is_object = F.schema_of_variant(d).startswith("OBJECT")
    first_word = F.lower(F.regexp_extract(_json_text(d, "tipo"), r"^\s*(\S+)", 1))
    kind = F.when(
        is_object & (_json_kind(d, "tipo") == "STRING") & first_word.isin(*RUNTIME_TYPES), first_word
    )
    # booleans are whole numbers to the rule
    delay_kind = _json_kind(d, "delay")
    # whole numbers beyond 64 bits come as decimals
    far = F.try_variant_get(d, "$.delay", "double")
    beyond = delay_kind.rlike(r"^DECIMAL\(\d+,0\)$") & (F.abs(far) >= float(1 << 63))
    given = (
        F.when(delay_kind == "BIGINT", F.try_variant_get(d, "$.delay", "bigint"))
        .when(delay_kind == "BOOLEAN", F.try_variant_get(d, "$.delay", "boolean").cast("bigint"))
        .when(beyond, F.when(far > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63))))
    )
    s = F.col(seed)
    delay = F.greatest(F.lit(DELAY_RANGE[0]), F.least(F.lit(DELAY_RANGE[1]), F.coalesce(given, _pick(DELAY_DEFAULTS, s))))

    def strip(field: str) -> Column:
        # a null term counts as the text None, so it is not empty
        told = F.when(_json_kind(d, field) == "VOID", "None").otherwise(_json_text(d, field))
        return F.regexp_replace(F.coalesce(told, F.lit("")), r"^\s+|\s+$", "")

    t = F.col("action_type")
    out = base.withColumn("action_type", kind).withColumn("delay_given", given)
    term_empty = (t == "buscar_google") & (strip("termino") == "")
    url_bad = (t == "abrir_url") & ~strip("url").startswith("http")
    search_empty = (t == "mirar_youtube") & (strip("busqueda") == "")
    fixed = given.isNull() | ~given.between(*DELAY_RANGE) | term_empty | url_bad | search_empty | (first_word != _json_text(d, "tipo"))
    return out.withColumns(
        {
            "delay": F.when(t.isNotNull(), delay.cast("bigint")),
            "term": F.when(term_empty, _pick(DEFAULT_TERMS, s)).when(t.isNotNull(), _json_text(d, "termino")),
            "url": F.when(url_bad, F.lit(DEFAULT_URL)).when(t.isNotNull(), _json_text(d, "url")),
            "search": F.when(search_empty, _pick(DEFAULT_SEARCHES, s)).when(t.isNotNull(), _json_text(d, "busqueda")),
            "was_repaired": t.isNotNull() & F.coalesce(fixed, F.lit(False)),
        }
    ).drop("_doc", "delay_given")


def strict_checks(outputs: DataFrame, text: str = "raw") -> DataFrame:
    """Validate against the published schema: flag ``valid`` and the first ``reason``."""
    d = F.col("_doc")
    base = outputs.withColumn("_doc", one_value(F.col(text)))
    is_object = F.coalesce(F.schema_of_variant(d).startswith("OBJECT"), F.lit(False))
    keys = F.when(is_object, F.json_object_keys(F.col(text)))
    kind = {f: _json_kind(d, f) for f in SCHEMA_FIELDS}
    type_text = _json_text(d, "type")
    delay = F.try_variant_get(d, "$.delay", "double")
    whole = (kind["delay"] == "BIGINT") | (
        (kind["delay"].startswith("DECIMAL") | (kind["delay"] == "DOUBLE")) & (delay == F.floor(delay))
    )

    def present(f: str) -> Column:
        return F.array_contains(keys, f)

    def bad_text(f: str) -> Column:
        size = F.char_length(_json_text(d, f))
        return present(f) & ~F.coalesce((kind[f] == "STRING") & size.between(*SCHEMA_LENGTH), F.lit(False))

    def when_type(t: str, cond: Column) -> Column:
        return F.coalesce(type_text == t, F.lit(False)) & cond

    rules = [
        (F.isnull(d), "not_json"),
        (~is_object, "not_an_object"),
        (F.size(F.array_except(keys, F.array(*map(F.lit, SCHEMA_FIELDS)))) > 0, "additional_field"),
        (~present("type"), "missing_type"),
        (~present("delay"), "missing_delay"),
        (~F.coalesce((kind["type"] == "STRING") & type_text.isin(*SCHEMA_TYPES), F.lit(False)), "type_not_allowed"),
        (~F.coalesce(whole, F.lit(False)), "delay_not_integer"),
        (~F.coalesce(delay.between(*SCHEMA_DELAY), F.lit(False)), "delay_out_of_range"),
        (bad_text("term"), "bad_term"),
        (present("url") & ~F.coalesce((kind["url"] == "STRING") & _json_text(d, "url").rlike("^https?://.+"), F.lit(False)), "bad_url"),
        (bad_text("search"), "bad_search"),
        (when_type("search_google", ~present("term")), "missing_term"),
        (when_type("search_google", present("url")), "forbidden_url"),
        (when_type("open_url", ~present("url")), "missing_url"),
        (when_type("open_url", present("term")), "forbidden_term"),
        (when_type("watch_youtube", present("url") & present("term")), "forbidden_url_and_term"),
    ]
    reason = reduce(lambda acc, r: acc.when(*r), rules[1:], F.when(*rules[0]))
    return base.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_doc")


def outcomes(attempts: DataFrame, max_tries: int = 2) -> DataFrame:
    """Per prompt: tries used, and the first valid action, else a fallback.

    Input: prompt, attempt (1-based), action_type (null when rejected), was_repaired.
    """
    tried = attempts.where(F.col("attempt") <= max_tries)
    good = F.when(F.col("action_type").isNotNull(), F.col("attempt"))
    first = F.min_by(F.struct("action_type", "was_repaired"), good)
    return tried.groupBy("prompt").agg(
        F.coalesce(F.min(good), F.count(F.lit(1))).cast("bigint").alias("attempts"), first.alias("_a")
    ).select(
        "prompt", "attempts",
        F.when(F.col("_a").isNull(), "fallback").when(F.col("_a.was_repaired"), "repaired").otherwise("valid").alias("outcome"),
        F.col("_a.action_type").alias("action_type"),
    )


def outcome_counts(per_prompt: DataFrame) -> DataFrame:
    return per_prompt.groupBy("outcome", "action_type").agg(
        F.count(F.lit(1)).alias("prompts"), F.sum("attempts").alias("attempts")
    )
