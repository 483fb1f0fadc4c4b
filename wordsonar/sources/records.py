"""Where records come from: tables with an id and a text, delimited lines, lists of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ErrorCode, SearchError

#: Kinds of ids: the type of the column, and the least and greatest value (None: not a number).
ID_KINDS = {
    "byte": ("smallint", 0, 255),
    "short": ("smallint", -(2**15), 2**15 - 1),
    "ushort": ("int", 0, 2**16 - 1),
    "int": ("int", -(2**31), 2**31 - 1),
    "uint": ("bigint", 0, 2**32 - 1),
    "long": ("bigint", -(2**63), 2**63 - 1),
    "ulong": ("decimal(20,0)", 0, 2**64 - 1),
    "guid": ("string", None, None),
}

_HEX = "[0-9a-fA-F]"
_GUID = rf"^(?:{_HEX}{{32}}|{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}|\{{{_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}\}}|\({_HEX}{{8}}(?:-{_HEX}{{4}}){{3}}-{_HEX}{{12}}\))$"
#: White space at either end, as trimming takes it; Spark's trim takes blanks only.
_BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ENDS = f"^{_BLANK}|{_BLANK}$"


#: Bytes of a file whose rows are spread over the cores, at least and at most.
SMALL_FILE = (1 << 20, 64 << 20)


def spread(df: DataFrame) -> DataFrame:
    """The rows of one small file over all cores: a file of one row group is else one task, whatever is done with it. Larger
    inputs, and those of several files, stay as they are."""
    least, most = SMALL_FILE
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if least <= size <= most and len(df.inputFiles()) == 1:
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
    return df


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def parse_id(text: Column, kind: str) -> Column:
    """A text as an id of a kind; null where it isn't one, or the kind is unknown."""
    if kind not in ID_KINDS:
        return F.lit(None).cast("string")
    to, low, high = ID_KINDS[kind]
    if low is None:
        plain = F.lower(F.regexp_replace(text, r"[-{}()]", ""))
        dashed = F.concat_ws("-", *[F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        return F.when(F.rlike(text, F.lit(_GUID)), dashed)
    # fewer digits than a decimal holds, without leading zeros
    number = F.when(F.rlike(text, F.lit(r"^\s*[+-]?\d+\s*$")), F.regexp_replace(F.regexp_replace(text, r"\s", ""), r"^([+-]?)0+(?=\d)", "$1")).try_cast("decimal(38,0)")
    bound = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    return F.when(number.between(bound(low), bound(high)), number).try_cast(to)


def lines_of(spark: SparkSession, lines: list[str | None]) -> DataFrame:
    """(line_no from 1, line) of lines on the driver."""
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(lines)], "line_no bigint, line string")


def numbered(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(line_no from 1, line) in the order of the partitions: one count of each partition, no shuffle of the lines."""
    marked = lines.select(F.monotonically_increasing_id().alias("at"), F.col(line_col).alias("line"))
    part = F.shiftright("at", 33)
    counts = sorted(marked.groupBy(part.alias("p")).count().collect())  # a row for each partition
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    offsets = lines.sparkSession.createDataFrame(rows, "p bigint, before bigint")
    joined = marked.withColumn("p", part).join(F.broadcast(offsets), "p")
    return joined.select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line_no"), "line")


_PROBLEMS = {
    ErrorCode.INVALID_SOURCE_RECORD: "the line is empty",
    ErrorCode.INVALID_DELIMITED_SOURCE_FORMAT: "no delimiter, or nothing before or after it",
    ErrorCode.INVALID_ID_FORMAT: "the id is not of the wanted type",
}


def parse_lines(lines: DataFrame, delimiter: str, id_kind: str = "int") -> DataFrame:
    """(line_no, id, text, problem) of (line_no, line): the line parts at the first delimiter, both sides trimmed;
    problem is an error code's value or null."""
    line = F.col("line")
    at = F.instr(line, delimiter)
    name = trimmed(F.substring(line, F.lit(1), at - 1))
    text = trimmed(F.substring(line, at + len(delimiter), F.length(line)))
    found = parse_id(name, id_kind)
    problem = (
        F.when(line.isNull() | (trimmed(line) == ""), ErrorCode.INVALID_SOURCE_RECORD.value)
        .when((at == 0) | (name == "") | (text == ""), ErrorCode.INVALID_DELIMITED_SOURCE_FORMAT.value)
        .when(found.isNull(), ErrorCode.INVALID_ID_FORMAT.value)
    )
    return lines.select("line_no", found.alias("id"), text.alias("text"), problem.alias("problem"))


def from_lines(lines: DataFrame, delimiter: str, id_kind: str = "int", lenient: bool = False) -> DataFrame:
    """(id, text) of (line_no, line). The first bad line raises, unless lenient, where bad lines are left out."""
    if not lenient and not (delimiter or "").strip():
        raise SearchError(ErrorCode.INVALID_DELIMITED_SOURCE_FORMAT, "no delimiter between id and text is given")
    parsed = parse_lines(lines, delimiter or ";", id_kind)
    if not lenient:
        bad = parsed.where("problem is not null").agg(F.min(F.struct("line_no", "problem"))).first()[0]
        if bad:
            code = ErrorCode(bad.problem)
            raise SearchError(code, f"Line {bad.line_no}: {_PROBLEMS[code]}")
    return parsed.where("problem is null").select("id", "text")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of all *.txt files of a folder: trimmed lines without blank ones and comments (#), one spelling of those
    that differ in case only (the first by code points), in order."""
    lines = spark.read.text(f"{path}/*.txt").select(trimmed(F.col("value")).alias("word"))
    lines = lines.where((F.col("word") != "") & ~F.startswith("word", F.lit("#")))
    return lines.groupBy(F.upper("word").alias("up")).agg(F.min("word").alias("word")).orderBy("up").select("word")

