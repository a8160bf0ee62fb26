"""Secret scans with an incremental blob ledger, wholly as DataFrame operations.

Every version of every path is addressed by its content (SHA-256). A blob is scanned once, and only by the rule
versions that the ledger doesn't have for it; findings are joined back to all paths with that content.

The ledger is a folder with one folder of Parquet files for each run, named by the run. A row holds a blob, the rule
versions that the run scanned it by, and their findings, each with its rule version; kinds and their order are those
of the rules that a reader asks for. Runs that didn't finish aren't read; a run that is repeated under its name
doesn't look at what it wrote before, and replaces it.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEDGER_SCHEMA = "blob string, rules array<string>, spans array<struct<begin:int,end:int,rule:string>>"


@dataclass(frozen=True)
class Rule:
    """A pattern; matches count if group ``group`` has ``least`` characters. ``any_of``: text that every match holds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_of: tuple[str, ...] = ()

    @property
    def version(self) -> str:
        said = f"{self.kind}\0{self.pattern}\0{self.group}\0{self.least}"
        return f"{self.kind}@{hashlib.sha256(said.encode()).hexdigest()[:16]}"


#: Fixed values of the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, ("=", ":")),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, ("AKIA",)),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),
)
#: Further public token formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, ("-----BEGIN ",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyJ",)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xox",)),
)
RULES = BASE_RULES + MORE_RULES

_PEM_MARK = "(?:[A-Z]+ )*PRIVATE KEY-----"
#: What is masked: as RULES, but a key from its header to the END line; where there is none, RFC 1421 headers and
#: base64 runs of 16 characters or more, and the shorter last line after a full one. Possessive, so that long
#: bodies are matched without recursion.
_PEM_BLOCK = (
    rf"-----BEGIN {_PEM_MARK}(?:(?:(?!-----)[\s\S])*+-----END {_PEM_MARK}"
    r"|(?:\s*(?:Proc-Type|DEK-Info): [^\r\n]*){0,9}"
    r"(?:(?!(?=[\s\\])(?:\s{0,9}+\\[nr]){0,9}+\s{0,40}+(?![A-Za-z0-9+/]{16}))(?!\\(?![nr]))[A-Za-z0-9+/=\s\\])*+"
    r"(?:(?<=[A-Za-z0-9+/]{60})[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]+={0,2}(?=[ \t\r]*(?:\n|\Z)))?)"
)
MASK_RULES = tuple(Rule(r.kind, _PEM_BLOCK, 0, 1, r.any_of) if r.kind == "pem" else r for r in RULES)


def blob_of(text_col: str) -> Column:
    """The content's address; a null text has that of an empty one."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _matches(rule: Rule, text: Column, wanted: Column) -> Column:
    """Lengths of what stands between the matches and of the matches; null if there are none."""
    pattern = F.lit(rule.pattern)
    whole, group = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    hits = F.zip_with(whole, group, lambda w, g: F.struct(F.length(w).alias("size"), (F.length(g) >= rule.least).alias("counts")))
    both = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h["size"].alias("size"), h["counts"].alias("counts")))
    likely = wanted
    if rule.any_of:
        held = F.lit(False)
        for part in rule.any_of:
            held = held | text.contains(part)
        likely = likely & held
    return F.when(likely & text.rlike(rule.pattern), both)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, begin, end, rule) of every finding; ``blobs`` has blob, text and the rule versions ``pending``.

    Offsets are code points. A pattern's matches don't overlap; where each begins is the sum of what stands before it.
    """
    found = F.array(
        *[
            F.struct(
                F.lit(rule.version).alias("rule"),
                _matches(rule, F.col("text"), F.array_contains("pending", rule.version)).alias("parts"),
            )
            for rule in rules
        ]
    )
    rows = blobs.select("blob", F.explode(F.filter(found, lambda f: f["parts"].isNotNull())).alias("f"))
    rows = rows.select("blob", "f.rule", F.posexplode("f.parts").alias("n", "part"))
    upto = Window.partitionBy("blob", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("part.gap") + F.coalesce(F.col("part.size"), F.lit(0))).over(upto).cast("int")
    placed = rows.withColumn("end", end).filter(F.col("part.counts"))
    return placed.select("blob", (F.col("end") - F.col("part.size")).alias("begin"), "end", "rule")


def read_ledger(spark: SparkSession, path: str, but: str | None = None) -> DataFrame | None:
    """The rows of all finished runs, except the run ``but``; None if there are none yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        return None
    done = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, "run=*/_SUCCESS"))
    runs = [s.getPath().getParent() for s in done]
    found = [r.toString() for r in runs if r.getName() != f"run={but}"]
    return spark.read.schema(LEDGER_SCHEMA).parquet(*found) if found else None


def unseen_blobs(df: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], text_col: str) -> DataFrame:
    """(blob, text, pending): one row for each content with a rule version that the ledger lacks."""
    every = F.array(*[F.lit(r.version) for r in rules])
    blobs = df.select(blob_of(text_col).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        return blobs.withColumn("pending", every)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    pending = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", pending.alias("pending")).filter(F.size("pending") > 0)


def _ordered(spans: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) from rows (blob, begin, end, rule): of these rules alone, by begin, then in the rules' order."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.version, k)])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.version, r.kind)])
    own = spans.filter(F.col("rule").isin([r.version for r in rules]))
    span = F.struct("begin", order[F.col("rule")].alias("order"), "end", kinds[F.col("rule")].alias("kind"))
    return own.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def update_ledger(df: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, *, run: str | None = None, text_col: str = "text") -> None:
    """Scan every content of ``df`` by the rule versions that the ledger lacks for it, and add what was found.

    ``run`` names the addition. A run that failed, or is made again under its name, replaces its own rows; two runs at
    once may scan the same contents, which readers see once. Contents without findings are noted too.
    """
    run = run or uuid.uuid4().hex
    unseen = unseen_blobs(df, read_ledger(df.sparkSession, path, but=run), rules, text_col)
    found = scan_blobs(unseen, rules).groupBy("blob").agg(F.collect_list(F.struct("begin", "end", "rule")).alias("spans"))
    rows = unseen.select("blob", F.col("pending").alias("rules")).join(found, "blob", "left")
    rows.select("blob", "rules", F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int,rule:string>>")).alias("spans")).write.mode("overwrite").parquet(f"{path}/run={run}")


def findings_by_blob(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, ledger_path: str | None = None, run: str | None = None, text_col: str = "text") -> DataFrame:
    """(blob, spans) for the contents with findings, sorted.

    With ``ledger_path`` the ledger is brought up to date by ``df`` first, and the findings are read from it: those
    of every content that it knows. Without one all contents of ``df`` are scanned.
    """
    if ledger_path is None:
        return _ordered(scan_blobs(unseen_blobs(df, None, rules, text_col), rules), rules)
    update_ledger(df, ledger_path, rules, run=run, text_col=text_col)
    known = read_ledger(df.sparkSession, ledger_path)
    return _ordered(known.select("blob", F.explode("spans").alias("s")).select("blob", "s.*"), rules)


def join_back(df: DataFrame, findings: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of ``columns``, so that no name can clash) of every row of ``df`` with what the findings have for
    its content (null: nothing found)."""
    rows = df.select(F.struct(*[F.col(c) for c in columns]).alias("row"), blob_of(text_col).alias("own"))
    # The key is taken anew so that both sides are dealt out by it, and many copies of one content can be split.
    other = findings.withColumn("key", F.lower("blob")).drop("blob")
    return rows.join(other, F.col("own") == F.col("key"), "left").drop("own", "key")


def _of(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def scan_documents(
    df: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    *,
    ledger_path: str | None = None,
    run: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``df``: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, in code points).

    Null and empty texts have no findings; ids may be null or repeated; other columns are not looked at; an empty
    table gives an empty one. Equal contents are scanned once, whole.
    """
    base = [r.kind for r in BASE_RULES]
    digest = findings_by_blob(df, rules, ledger_path=ledger_path, run=run, text_col=text_col).select(
        "blob",
        *[F.size(_of([kind])).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(_said(_of(base)), 256).alias("base_sha256"),
        _said(F.col("spans")).alias("spans"),
    )
    rows = join_back(df.select(id_col, text_col), digest, [id_col], text_col)
    return rows.select(
        F.col("row")[id_col].alias(id_col),
        *[F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in base],
        F.coalesce("base_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(df: DataFrame, rules: tuple[Rule, ...] = MASK_RULES, *, mask: str = "[SECRET]", ledger_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with its own columns; in its texts every stretch of overlapping findings is replaced by the mask.

    Private keys are masked with their bodies (MASK_RULES), though scans report their headers alone. Rows without findings, null texts and repeated rows pass as they are.
    """
    spans = findings_by_blob(df, rules, ledger_path=ledger_path, text_col=text_col)
    rows = join_back(df, spans, df.columns, text_col)
    text = F.col("row")[text_col]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a: Column, s: Column) -> Column:
        before = F.substring(text, a["at"] + 1, s["begin"] - a["at"])
        out = F.when(s["begin"] >= a["at"], F.concat(a["out"], before, F.lit(mask))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate("spans", start, add, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return rows.select(F.col("row").withField(text_col, F.when(F.col("spans").isNull(), text).otherwise(masked)).alias("row")).select("row.*")
