"""A tidy, verb-based dataframe library on Spark."""

from .dtypes import Bool, Date, Datetime, Float64, Int64, Null, Str
from .errors import BackendError, ColumnNotFoundError, DuplicateColumnError, ExprTypeError, GroupError
from .functions.expr import BoolExpr, NumExpr, StrExpr, TemporalExpr, case_when, coalesce, col, cum_max, cum_min, cum_sum, dense_rank, desc, if_else, lag, lead, lit, min_rank, n, percent_rank, replace_na, row_number, typed_col
from .operators.frame import Frame, GroupedFrame
from .operators.select import across, contains, ends_with, everything, is_bool, is_numeric, is_string, matches, starts_with, where
from .options import options
from .sources.io import Database, from_schema, read, read_csv, read_duckdb, read_ipc, read_parquet, read_sql, read_table, register_format, write

__all__ = [k for k in dir() if not k.startswith("_")]
