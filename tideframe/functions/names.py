"""The feature-name grammar callers rely on, and column kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def safe(name: str) -> str:
    return str(name).translate(str.maketrans({" ": "_", "/": "_"}))


def lag_name(col: str, rows: int) -> str:
    return f"{safe(col)}__lag{rows}"


def rolling_name(col: str, rows: int, stat: str) -> str:
    return f"{safe(col)}__roll{rows}_{stat}"


def ewm_name(col: str, span: int) -> str:
    return f"{safe(col)}__ewm{span}"


def diff_name(col: str, rows: int) -> str:
    return f"{safe(col)}__diff{rows}"


def pct_name(col: str) -> str:
    return f"{safe(col)}__pct1"


def ratio_name(a: str, b: str) -> str:
    return f"{safe(a)}__over__{safe(b)}"


def minus_name(a: str, b: str) -> str:
    return f"{safe(a)}__minus__{safe(b)}"


def q(name: str) -> str:
    """Back-quote a column name for use in ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def kind(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "categorical"


def kinds(df: DataFrame, skip: tuple[str, ...] = ()) -> dict[str, str]:
    return {f.name: kind(f.dataType) for f in df.schema.fields if f.name not in skip}


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    return [c for c, k in kinds(df, skip).items() if k == "numeric"]
