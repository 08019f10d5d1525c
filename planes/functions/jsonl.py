"""Strict decoding of JSON lines against a closed schema.

Spark's reader is more lenient than the producers' contract: it stringifies numbers in
string fields, ignores text after the object, accepts single quotes and NaN, and nulls
only the field that does not fit. Here any of those drops the whole line, while a null
or a missing field takes its type's zero value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_READER = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_bad",
    "allowNonNumericNumbers": "false",
    "allowSingleQuotes": "false",
}

# The characters trimmed from both ends of a line.
LINE_SPACE = " \t\n\x0b\x0c\r\x85\xa0"


def zero_filled(value: Column, dtype: T.DataType) -> Column:
    """Null becomes the zero value of its type: empty text, false or 0."""
    zero = "" if isinstance(dtype, T.StringType) else False if isinstance(dtype, T.BooleanType) else 0
    return F.coalesce(value, F.lit(zero).cast(dtype))


def _enveloped(line: Column) -> Column:
    # Inside an array inside an object, text after the line's own object can no longer
    # be ignored by the parser, and a second object shows as a second element.
    return F.concat(F.lit('{"d":['), line, F.lit("]}"))


def _ends_with_itself(line: Column) -> Column:
    """The line's own object is all there is: no text after it closes the envelope early.

    What closes the array and the object around it can't also close a lone object, so such
    a line fails in an envelope of another shape. Only lines with a closing bracket can.
    """
    other = F.from_json(F.concat(F.lit('{"x":'), line, F.lit("}")), "struct<x:string,_bad:string>", _READER)
    whole = F.exists(F.array(other), lambda row: row["_bad"].isNull() & row["x"].isNotNull())
    return F.when(line.contains("]"), whole).otherwise(True)


def _ddl(schema: T.StructType, string_type: str) -> str:
    fields = ",".join(
        f"`{f.name}`:{string_type if f.dataType == T.StringType() else f.dataType.simpleString()}"
        for f in schema.fields
    )
    return f"struct<d:array<struct<{fields}>>,_bad:string>"


def _strings_are_strings(line: Column, names: list[str]) -> Column:
    """No string field holds a number, boolean, array or object.

    One regular expression clears almost every line; only lines it suspects are parsed
    again with the values' own types.
    """
    suspect = line.rlike(rf'"(?:{"|".join(names)})"\s*:\s*[^"n\s]') | line.contains("\\u")
    typed = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def clean(row: Column) -> Column:
        first = F.get(row["d"], F.lit(0))
        checks = F.lit(True)
        for name in names:
            kind = F.coalesce(F.schema_of_variant(first[name]), F.lit("VOID"))
            checks &= kind.isin("STRING", "VOID")
        return checks

    kinds = F.array(F.from_json(_enveloped(line), _ddl(typed, "variant"), _READER))
    return F.when(suspect, F.exists(kinds, clean)).otherwise(True)


def decode_lines(
    df: DataFrame,
    schema: T.StructType,
    *,
    line: str = "line",
    unsigned: tuple[str, ...] = (),
    raw_json: tuple[str, ...] = (),
    strict: bool = True,
) -> DataFrame:
    """Replace column ``line`` by the fields of ``schema``; bad lines vanish.

    ``unsigned`` names the integer fields that must not be negative and ``raw_json`` the
    string fields that may hold any JSON value, kept as text. ``strict=False`` leaves out
    the check that string fields hold strings.
    """
    keep = [c for c in df.columns if c != line]
    names = [f.name for f in schema.fields if f.dataType == T.StringType() and f.name not in raw_json]

    def trimmed(text: Column) -> Column:
        braced = text.startswith("{") & text.endswith("}")
        return F.when(braced, text).otherwise(F.btrim(text, F.lit(LINE_SPACE)))

    def sound(row: Column) -> Column:
        first = F.get(row["d"], F.lit(0))
        checks = row["_bad"].isNull() & (F.size(row["d"]) == 1) & first.isNotNull()
        for f in schema.fields:
            if f.dataType == T.DoubleType():
                checks &= F.coalesce(F.abs(first[f.name]) < float("inf"), F.lit(True))
        for name in unsigned:
            checks &= F.coalesce(first[name] >= 0, F.lit(True))
        return checks

    # The steps work on an array of one line that ends up with one row or none, and the
    # row is generated from it. So each line is computed and parsed once; as filters they
    # would be pushed below the projection and repeat both.
    found = F.filter(F.transform(F.array(line), trimmed), _ends_with_itself)
    if strict:
        found = F.filter(found, lambda text: _strings_are_strings(text, names))
    found = F.transform(found, lambda text: F.from_json(_enveloped(text), _ddl(schema, "string"), _READER))
    rows = df.select(*keep, F.explode(F.filter(found, sound)).alias("_row"))
    rows = rows.select(*keep, F.get("_row.d", F.lit(0)).alias("_row"))
    return rows.select(
        *keep, *[zero_filled(F.col("_row")[f.name], f.dataType).alias(f.name) for f in schema.fields]
    )
