"""Row shapes at each boundary, and checks that a table has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolebook import vocab


_TEXTS = T.ArrayType(T.StringType())
_HISTORY = T.ArrayType(
    T.StructType(
        [
            T.StructField("score", T.IntegerType()),
            T.StructField("verdict", T.StringType()),
            T.StructField("date", T.StringType()),
        ]
    )
)
_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "texts": _TEXTS,
    "history": _HISTORY,
    "scores": T.MapType(T.StringType(), T.DoubleType()),
    "extra": T.MapType(T.StringType(), T.StringType()),
}


def _struct(*fields: tuple[str, str, bool, str]) -> T.StructType:
    """(name, type, required, note) rows as a StructType."""
    return T.StructType([T.StructField(n, _TYPES[t], not required, {"note": note}) for n, t, required, note in fields])


POSTING = _struct(
    ("id", "string", True, "portal-prefixed id"),
    ("title", "string", True, ""),
    ("company", "string", True, "Unknown when the source names none"),
    ("location", "string", False, "NULL: the source did not state it"),
    ("posted_date", "date", False, "NULL: undated or not a date"),
    ("url", "string", True, ""),
    ("portal", "string", True, "which feed produced the row"),
    ("source", "string", True, "adapter or fallback"),
)

SEEN = _struct(
    ("key", "string", True, "dedupe key"),
    ("title", "string", False, ""),
    ("company", "string", False, ""),
    ("location", "string", False, "a place, never a verdict"),
    ("url", "string", False, ""),
    ("portal", "string", False, ""),
    ("first_seen", "date", False, ""),
    ("posted_date", "string", False, "as stated; not always a date"),
    ("status", "string", False, "new, scored, ranked, skipped, expired, seen"),
    ("scores", "scores", False, "the four dimensions"),
    ("rank_score", "int", False, ""),
    ("rank_verdict", "string", False, "a score band"),
    ("rank_date", "date", False, "day of the last scoring"),
    ("rank_history", "history", False, "last five scores"),
    ("location_verdict", "string", False, "PASS, FAIL or FLAG"),
    ("language_gate", "string", False, "absence never clears a stored FAIL"),
    ("language_note", "string", False, "quoted evidence"),
    ("deadline", "string", False, "as stated; absence is no correction"),
    ("strengths", "texts", False, "at most three"),
    ("gaps", "texts", False, "at most three"),
    ("extra", "extra", False, "fields not declared here, as JSON"),
)

TRACKER = _struct(*[(c, "string", c in ("company", "role", "status"), "") for c in vocab.TRACKER_COLUMNS])

SOURCE_NOTE = _struct(
    ("portal", "string", True, ""),
    ("ok", "boolean", True, ""),
    ("rows", "bigint", True, ""),
    ("truncated", "boolean", False, "the source may hold more rows"),
    ("error", "string", False, "present when ok is false"),
)

GATE = _struct(("gate", "string", True, ""), ("verdict", "string", True, "PASS, FAIL or FLAG"), ("note", "string", True, "quoted evidence"))

CANDIDATE = _struct(
    ("candidate_id", "string", True, ""),
    ("stage", "string", True, "student, fresher, experienced, remote-global"),
    ("skills", "texts", True, ""),
    ("locations", "texts", True, "empty: anywhere"),
    ("grad_year", "int", False, ""),
    ("stipend_floor", "double", False, "per month"),
    ("ctc_floor", "double", False, "lakhs per year"),
    ("market", "string", True, ""),
)

SHAPES: dict[str, T.StructType] = {
    "posting": POSTING,
    "seen": SEEN,
    "tracker": TRACKER,
    "source_note": SOURCE_NOTE,
    "gate": GATE,
    "candidate": CANDIDATE,
}


def contract_df(spark: SparkSession) -> DataFrame:
    """The contract as a table: shape, position, field, type, required, note."""
    rows = [
        (shape, i, f.name, f.dataType.simpleString(), not f.nullable, f.metadata.get("note", ""))
        for shape, struct in SHAPES.items()
        for i, f in enumerate(struct.fields)
    ]
    return spark.createDataFrame(rows, "shape string, position int, field string, type string, required boolean, note string")


def conform(df: DataFrame, shape: str) -> DataFrame:
    """The shape's columns in order. Missing optional columns are NULL; a
    missing required column or a different type is refused."""
    struct, have = SHAPES[shape], {f.name: f.dataType for f in df.schema.fields}
    problems = [
        f"{f.name}: missing" if f.name not in have else f"{f.name}: {have[f.name].simpleString()}, not {f.dataType.simpleString()}"
        for f in struct.fields
        if (f.name not in have and not f.nullable) or (f.name in have and not same_type(have[f.name], f.dataType))
    ]
    if problems:
        raise ValueError(f"not a {shape} table: " + "; ".join(problems))
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)) for f in struct.fields]
    )


def same_type(a: T.DataType, b: T.DataType) -> bool:
    return a.simpleString() == b.simpleString()


def required_nulls(df: DataFrame, shape: str) -> DataFrame:
    """Rows per required field that hold NULL there."""
    required = [f.name for f in SHAPES[shape].fields if not f.nullable]
    counts = F.array(
        *[F.struct(F.lit(n).alias("field"), F.count_if(F.col(n).isNull()).alias("nulls")) for n in required]
    )
    return df.agg(counts.alias("c")).select(F.inline("c"))


def enum_violations(df: DataFrame, column: str, allowed) -> DataFrame:
    """Values outside a closed vocabulary, with their rows."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(True))).groupBy(column).agg(
        F.count(F.lit(1)).alias("rows")
    )
