"""Table contracts: column checks that never change data, and normalisation that then checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bad values that an error shows.
EXAMPLES = 5
TRUE_TOKENS, FALSE_TOKENS = ("true", "1"), ("false", "0")


class ContractError(ValueError):
    """A table that doesn't keep its contract."""


def names(x: str | Iterable[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Names trimmed and in lower case; two that become the same are an error."""
    made = [c.strip().lower() for c in df.columns]
    if twice := sorted({c for c in made if made.count(c) > 1}):
        raise ContractError(f"columns meet in {twice}")
    return df.toDF(*made)


def select_columns(df: DataFrame, columns: Iterable[str], require: bool = True) -> DataFrame:
    """Columns in the order asked for; those that aren't there are an error, or left out."""
    wanted = list(columns)
    if require:
        require_columns(df, wanted)
    return df.select(*(c for c in wanted if c in df.columns))


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"missing columns {missing}")


def duplicate_mask(df: DataFrame, key: str | Sequence[str], keep: str | bool = False, order: Sequence[str] = ()) -> DataFrame:
    """Adds duplicate: all rows of a repeated key, or all but the 'first' or the 'last' of them in order."""
    keys = names(key)
    if keep is False:
        flag = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    elif keep in ("first", "last"):
        by = [F.asc(c) if keep == "first" else F.desc(c) for c in (order or keys)]
        flag = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) > 1
    else:
        raise ValueError("keep is False, 'first' or 'last'")
    return df.withColumn("duplicate", flag)


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with how many do; counted before the exchange."""
    return df.groupBy(*names(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique_key(df: DataFrame, key: str | Sequence[str]) -> None:
    if found := duplicate_keys(df, key).limit(EXAMPLES).collect():
        raise ContractError(f"{names(key)} is not unique: {[tuple(r)[:-1] for r in found]}")


def require_datetime(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
        raise ContractError(f"{column} holds no dates")


def string_value(c: Column, upper: bool = False) -> Column:
    """Text without white space around it; empty is missing."""
    out = F.nullif(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))
    return F.upper(out) if upper else out


def number_value(c: Column) -> Column:
    """A double, or missing where there is none."""
    return F.expr("try_cast(_v as double)") if c is None else c.cast("string").try_cast("double")


def is_missing(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def bad_integer(c: Column, allow_missing: bool) -> Column:
    x = c.cast("string").try_cast("double")
    wrong = ~is_missing(c) & (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x != F.floor(x)))
    return wrong if allow_missing else wrong | is_missing(c)


def bad_number(c: Column, allow_missing: bool, allow_infinite: bool, nonnegative: bool) -> Column:
    x = c.cast("string").try_cast("double")
    wrong = ~is_missing(c) & (x.isNull() | F.isnan(x))
    if not allow_infinite:
        wrong |= F.coalesce(F.abs(x) == float("inf"), F.lit(False))
    if nonnegative:
        wrong |= F.coalesce(x < 0, F.lit(False))
    return wrong if allow_missing else wrong | is_missing(c)


def binary_value(c: Column, true: Sequence[str] = TRUE_TOKENS, false: Sequence[str] = FALSE_TOKENS) -> Column:
    """True or false from tokens, whatever their case and white space, and from 0 and 1 in any decimal form."""
    token = F.lower(F.trim(c.cast("string")))
    as_number = token.try_cast("double")
    token = F.when(as_number == 1, "1").when(as_number == 0, "0").otherwise(token)
    return F.when(token.isin(*true), F.lit(True)).when(token.isin(*false), F.lit(False))


def datetime_value(c: Column, form: str | None = None) -> Column:
    text = c.cast("string")
    return F.try_to_timestamp(text, F.lit(form)) if form else F.try_to_timestamp(text)


def refuse(df: DataFrame, checks: dict[str, Column]) -> None:
    """One aggregation for all checks; an error shows a few of the first broken one's values."""
    if not checks:
        return
    counts = df.agg(*(F.count_if(bad).alias(c) for c, bad in checks.items())).first()
    for c, bad in checks.items():
        if counts[c]:
            shown = [r[0] for r in df.where(bad).select(c).limit(EXAMPLES).collect()]
            raise ContractError(f"{c} has {counts[c]} bad values, such as {shown}")


def normalize_dataframe(
    df: DataFrame,
    usecols: Iterable[str] | None = None,
    lower_names: bool = False,
    string: Iterable[str] = (),
    integer: Iterable[str] = (),
    numeric: Iterable[str] = (),
    binary: Iterable[str] = (),
    datetime: Iterable[str] = (),
    nonnegative: Iterable[str] = (),
    nonmissing: Iterable[str] = (),
    unique: str | Sequence[str] | None = None,
) -> DataFrame:
    """Columns brought to their kinds, after a check that all values have a form of theirs."""
    string, integer, numeric, binary, datetime = map(list, (string, integer, numeric, binary, datetime))
    groups = [*string, *integer, *numeric, *binary, *datetime]
    if twice := sorted({c for c in groups if groups.count(c) > 1}):
        raise ContractError(f"columns of two kinds: {twice}")
    if lower_names:
        df = normalize_columns(df)
    if usecols is not None:
        df = select_columns(df, usecols)
    require_columns(df, [*groups, *nonmissing])
    checks = {c: bad_integer(F.col(c), True) for c in integer}
    checks |= {c: bad_number(F.col(c), True, False, c in set(nonnegative)) for c in numeric}
    checks |= {c: ~is_missing(F.col(c)) & binary_value(F.col(c)).isNull() for c in binary}
    checks |= {c: F.col(c).isNotNull() & datetime_value(F.col(c)).isNull() for c in datetime}
    for c in nonmissing:
        checks[c] = checks.get(c, F.lit(False)) | is_missing(F.col(c))
    refuse(df, checks)
    made = {c: string_value(F.col(c)) for c in string}
    made |= {c: F.col(c).cast("string").try_cast("double").cast("long") for c in integer}
    made |= {c: F.col(c).cast("string").try_cast("double") for c in numeric}
    made |= {c: binary_value(F.col(c)) for c in binary}
    made |= {c: datetime_value(F.col(c)) for c in datetime}
    out = df.withColumns(made)
    if unique is not None:
        require_unique_key(out, unique)
    return out


def validate_dataframe(
    df: DataFrame,
    usecols: Iterable[str] | None = None,
    string: Iterable[str] = (),
    integer: Iterable[str] = (),
    numeric: Iterable[str] = (),
    binary: Iterable[str] = (),
    datetime: Iterable[str] = (),
    nonmissing: Iterable[str] = (),
    unique: str | Sequence[str] | None = None,
) -> DataFrame:
    """df as it is, if its columns have the kinds and values said; nothing is converted."""
    kinds = [(string, T.StringType), (integer, T.IntegralType), (numeric, T.NumericType), (binary, T.BooleanType)]
    for columns, kind in kinds:
        for c in columns:
            require_columns(df, [c])
            if not isinstance(df.schema[c].dataType, kind):
                raise ContractError(f"{c} is {df.schema[c].dataType.simpleString()}")
    for c in datetime:
        require_datetime(df, c)
    refuse(df, {c: is_missing(F.col(c)) for c in nonmissing})
    if unique is not None:
        require_unique_key(df, unique)
    return select_columns(df, usecols) if usecols is not None else df


def clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Existing columns of columns, in the rows where all of them are there and finite."""
    have = [c for c in columns if c in df.columns]
    kinds = dict(df.dtypes)
    made = [F.when(F.abs(c) == float("inf"), None).when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in have]
    return df.select(*made).dropna("any")


def complete(columns: Sequence[str], kinds: Mapping[str, str], how: str = "any") -> Column:
    """Whether a row has all (how "any" missing drops it) or any ("all") of columns, there and finite.

    kinds: type names by column, as in dict(df.dtypes)."""
    if how not in ("any", "all"):
        raise ValueError(f"unknown rule {how!r}")
    there = [F.col(c).isNotNull() & ((~F.isnan(c) & (F.abs(c) != float("inf"))) if kinds[c] in ("double", "float") else F.lit(True)) for c in columns]
    return reduce(and_ if how == "any" else or_, there, F.lit(how == "any"))


def match_sample(df: DataFrame, columns: Sequence[str], how: str = "inner", mask: Column | None = None) -> DataFrame:
    """Rows with all (inner) or any (outer) of columns, or of a mask (custom); what is missing then is 0."""
    if how == "custom":
        if mask is None:
            raise ValueError("a custom sample needs a mask")
        return df.where(mask).fillna(0.0, list(columns))
    if how not in ("inner", "outer"):
        raise ValueError(f"unknown sample {how!r}")
    return df.dropna("any" if how == "inner" else "all", subset=list(columns)).fillna(0.0, list(columns))


def null_numeric_tokens(c: Column, tokens: Sequence[str] = ("", "NA", "N/A", "NAN", "NULL", "NONE", "EXEMPT", ".")) -> Column:
    """Text of a number: tokens for nothing are missing, white space inside goes, well-placed commas too."""
    plain = F.regexp_replace(F.trim(c), r"\s+", "")
    plain = F.when(F.upper(plain).isin(*tokens), None).otherwise(plain)
    return F.when(plain.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$"), F.replace(plain, F.lit(","), F.lit(""))).otherwise(plain)


def domain(c: Column, values: Sequence[str]) -> Column:
    """A value of a fixed domain; others are missing."""
    return F.when(c.isin(*values), c)


def canonical(df: DataFrame, columns: Sequence[tuple[str, str, str]], provenance: dict[str, str]) -> DataFrame:
    """(name, source, type) columns from a differently named table: cast where there, missing where not,
    and constant columns that tell where the rows came from. Filters and column choices on the result
    pass through to the scan."""
    made = [F.col(s).try_cast(t).alias(n) if s in df.columns else F.lit(None).cast(t).alias(n) for n, s, t in columns]
    return df.select(*made, *(F.lit(v).alias(k) for k, v in provenance.items()))
