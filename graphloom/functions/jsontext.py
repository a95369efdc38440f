"""Reading JSON objects out of model output text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import strip


def _braces(t: Column) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is no such span."""
    start = F.locate("{", t)
    end = F.length(t) - F.locate("}", F.reverse(t)) + 1
    return F.when((start > 0) & F.contains(t, F.lit("}")) & (end > start), t.substr(start, end - start + 1))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def json_value(text) -> Column:
    """The text as one JSON value; NULL when it is not exactly that.

    The parser stops after the first value, so the text is read inside an array and inside an object:
    both fail unless the value ends where the text ends.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    alone = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return let(items, lambda a: F.when((F.size(a) == 1) & alone, F.get(a, F.lit(0))))


def with_tolerant_json(df: DataFrame, column: str, out: str = "json") -> DataFrame:
    """Adds the JSON object text of a possibly fenced answer; trailing commas are forgiven; NULL when unreadable.

    Each stage is computed once inside one expression. As columns of their own, stages are written out in full at every use as soon
    as a filter on the result is pushed below them.
    """
    fenced = r"```(?:json)?\s*([\s\S]*?)```"

    def inside(t):
        return F.when(t.rlike(fenced), strip(F.regexp_extract(t, fenced, 1))).otherwise(t)

    def readable(t):
        return F.when(json_value(t).isNotNull(), t)

    def read(raw):
        return F.coalesce(readable(raw), let(F.regexp_replace(raw, r",\s*([}\]])", "$1"), readable))

    text = let(let(let(strip(F.col(column)), inside), _braces), read)
    return df.select(*[c for c in df.columns if c != out], text.alias(out))


def strict_json(text) -> Column:
    """struct(json, error): all fence marks removed, no repair."""
    bare = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?i)```(?:json)?", "")

    def judged(raw):
        ok = json_value(raw).isNotNull()
        error = F.when(raw.isNull(), "输出中未找到JSON对象").when(~ok, "JSON解析失败")
        return F.struct(F.when(ok, raw).alias("json"), error.alias("error"))

    return let(let(bare, _braces), judged)


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_kind(v: Column, kind: str) -> Column:
    """Whether a variant is of a kind (STRING, OBJECT, ARRAY, BOOLEAN); False for a missing one."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def string_field(v: Column, name: str) -> Column:
    """Text of a field that holds a text, trimmed; NULL for other kinds."""
    f = field(v, name)
    return F.when(is_kind(f, "STRING"), strip(F.try_variant_get(v, f"$.{name}", "string")))


def text_field(v: Column, name: str) -> Column:
    """Any primitive field as text; empty when missing, false or zero."""
    s = F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    return F.when(s.isin("false", "0") & ~is_kind(field(v, name), "STRING"), "").otherwise(s)


def truthy(v: Column, name: str) -> Column:
    f = field(v, name)
    s = F.try_variant_get(v, f"$.{name}", "string")
    return (F.when(f.isNull() | F.is_variant_null(f), F.lit(False)).when(is_kind(f, "STRING"), s != "")
            .when(is_kind(f, "OBJECT") | is_kind(f, "ARRAY"), F.lit(True)).otherwise(~s.isin("false", "0")))


def integer_field(v: Column, name: str) -> Column:
    """Whole-number value of a numeric field; NULL for anything else."""
    f = field(v, name)
    numeric = is_kind(f, "BIGINT") | is_kind(f, "DECIMAL") | is_kind(f, "DOUBLE")
    d = F.try_variant_get(v, f"$.{name}", "double")
    return F.when(numeric & (d == F.floor(d)), d.cast("long"))


def elements(v: Column, name: str) -> Column:
    """Array field as array<variant>; empty when it is not an array."""
    return F.when(is_kind(field(v, name), "ARRAY"), F.try_variant_get(v, f"$.{name}", "array<variant>")).otherwise(
        F.array().cast("array<variant>"))
