"""Declared schemas, header detection, inference, and a registry that unions what it is told."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the known datasets, in order.
_BARS = "open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, count long, taker_buy_volume double, taker_buy_quote_volume double, ignore double"
KNOWN: dict[str, str] = {
    "klines": _BARS,
    "markPriceKlines": _BARS,
    "indexPriceKlines": _BARS,
    "premiumIndexKlines": _BARS,
    "fundingRate": "calc_time long, funding_interval_hours long, last_funding_rate double",
    "aggTrades": "agg_trade_id long, price double, quantity double, first_trade_id long, last_trade_id long, transact_time long, is_buyer_maker boolean",
    "trades": "id long, price double, qty double, quote_qty double, time long, is_buyer_maker boolean",
    "bookTicker": "update_id long, best_bid_price double, best_bid_qty double, best_ask_price double, best_ask_qty double, transaction_time long, event_time long",
    "bookDepth": "timestamp long, percentage double, depth double, notional double",
}
#: Names among which an inspected file's time key is looked for; the order of its columns decides.
TIME_NAMES = ("open_time", "close_time", "event_time", "timestamp", "time", "calc_time", "transact_time")

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def known_schema(dataset: str) -> T.StructType | None:
    """Also in a worker, where there is no session to parse a text."""
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    pairs = [c.split() for c in KNOWN[dataset].split(", ")] if dataset in KNOWN else None
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs]) if pairs else None


def is_header(tokens: Sequence[str], expected: Iterable[str] | None = None) -> bool:
    """Whether a first line names columns: half of it known names, or, of an unknown dataset, more words than values."""
    tokens = [t.strip().strip('"') for t in tokens]
    if not tokens:
        return True
    if expected:
        return len(set(expected) & set(tokens)) >= max(1, len(tokens) // 2)
    words = sum(bool(re.search(r"[^\W\d]", t)) and not _NUMBER.match(t) and t.lower() not in ("true", "false") for t in tokens)
    return words > len(tokens) - words


def column_names(first_line: str, dataset: str) -> tuple[list[str], bool]:
    """Names of a file's columns, and whether its first line is a header."""
    tokens = [t.strip().strip('"') for t in first_line.split(",")]
    schema = known_schema(dataset)
    if is_header(tokens, schema.names if schema else None):
        return tokens, True
    if schema and len(schema) == len(tokens):
        return schema.names, False
    return [f"col_{i}" for i in range(len(tokens))], False


#: What tells aggregated trades apart if they have no id.
TRADE_KEY = ("timestamp", "price", "quantity", "first_trade_id", "last_trade_id")


def agg_trade_keys(columns: Sequence[str]) -> list[str]:
    """The columns by which repeats of aggregated trades are found: the id, else the five of TRADE_KEY (either name of the time), else none."""
    if "agg_trade_id" in columns:
        return ["agg_trade_id"]
    found = ["transact_time" if k == "timestamp" and k not in columns else k for k in TRADE_KEY]
    return found if set(found) <= set(columns) else []


def key_notes(dataset: str, columns: Sequence[str]) -> list[str]:
    """What there is to note of a source that has no key."""
    return ["no key tells repeats; in order of time only"] if dataset == "aggTrades" and not agg_trade_keys(columns) else []


def validation(dataset: str, names: Sequence[str]) -> str:
    schema = known_schema(dataset)
    return "unknown" if schema is None else "valid" if list(names) == schema.names else "invalid"


def time_key(names: Sequence[str]) -> str | None:
    return next((n for n in names if n in TIME_NAMES), None)


def symbol_of_file(name: Column) -> Column:
    """The symbol that a file name or path begins with: the text before the first ``-`` of its last part."""
    return F.substring_index(F.element_at(F.split(name, "/"), -1), "-", 1)


def sample_date(url: str) -> str:
    found = re.search(r"-(\d{4}-\d{2}-\d{2}|\d{4}-\d{2})\.(zip|csv)$", url)
    return found[1] if found else "unknown"


def inspect(df: DataFrame, dataset: str) -> dict:
    """What there is to register of a file that has been read."""
    names = df.columns
    dtypes = {n: {"bigint": "int64", "int": "int64", "double": "float64", "float": "float64", "boolean": "bool"}.get(t, "str") for n, t in df.dtypes}
    key = time_key(names)
    return {"dataset_type": dataset, "columns": names, "dtypes": dtypes, "primary_time_key": key, "join_key": key, "validation_status": validation(dataset, names)}


@dataclass
class RegisteredSchema:
    dataset_type: str
    columns: list[str]
    dtypes: dict[str, str] = field(default_factory=dict)
    primary_time_key: str | None = None
    join_key: str | None = None
    field_notes: dict[str, str] = field(default_factory=dict)
    validation_status: str = "unknown"


class SchemaRegistry:
    """Schemas by dataset: one row each, so it is driver-side state that reads from and writes to a DataFrame."""

    DDL = "dataset_type string, columns array<string>, dtypes string, primary_time_key string, join_key string, field_notes string, validation_status string"
    SAMPLES_DDL = "dataset_type string, url string, sample_date string, header boolean"

    def __init__(self, spark: SparkSession):
        self.spark, self.schemas, self.samples = spark, {}, []

    def register(self, schema: RegisteredSchema) -> RegisteredSchema:
        """New columns come after the old ones; types and the rest are the newest, keys only if given."""
        old = self.schemas.get(schema.dataset_type)
        if old:
            schema = RegisteredSchema(
                schema.dataset_type, old.columns + [c for c in dict.fromkeys(schema.columns) if c and c not in old.columns], old.dtypes | schema.dtypes,
                schema.primary_time_key or old.primary_time_key, schema.join_key or old.join_key, schema.field_notes, schema.validation_status,
            )
        self.schemas[schema.dataset_type] = schema
        return schema

    def get(self, dataset: str) -> RegisteredSchema | None:
        return self.schemas.get(dataset)

    def add_sample(self, dataset: str, url: str, header: bool) -> None:
        self.samples.append((dataset, url, sample_date(url), header))

    def to_df(self) -> DataFrame:
        rows = [tuple(json.dumps(v) if isinstance(v, dict) else v for v in asdict(s).values()) for s in self.schemas.values()]
        return self.spark.createDataFrame(rows, self.DDL)

    def samples_df(self) -> DataFrame:
        return self.spark.createDataFrame(self.samples, self.SAMPLES_DDL)

    @classmethod
    def from_df(cls, df: DataFrame) -> SchemaRegistry:
        made = cls(df.sparkSession)
        for r in df.collect():  # one row a dataset
            made.schemas[r["dataset_type"]] = RegisteredSchema(r["dataset_type"], list(r["columns"]), json.loads(r["dtypes"]), r["primary_time_key"], r["join_key"], json.loads(r["field_notes"]), r["validation_status"])
        return made


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; missing columns are null and types widen."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared types (a value that doesn't fit is null), then the rest."""
    known = [(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema]
    return df.select(*known, *[c for c in df.columns if c not in schema.names])
