"""A staged corpus on shared storage, and the import of a package into it: all of it or nothing.

Each table is cut into buckets by a hash of its key. A run writes only the buckets that hold a changed row, into a folder of its
own, and then one manifest row that says for every bucket of every table which run's files are current. That row makes the whole
run visible; a run that dies before it leaves files that nobody reads, and running it again replaces them. A reader opens one
manifest row and reads all tables as of that run. Logs (aliases, content versions, runs) are appended, a folder a run.

A commit is refused if another run was published since the corpus was opened. A run id that is published already changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.identity import row_fingerprint
from attestry.functions.text import title_key
from attestry.operators import staging as G
from attestry.operators.validate import accepted, all_violations, broken
from attestry.session import cut_lineage
from attestry.sources.sinks import run_log

_STORED = "fingerprint string, import_run_id string, created_at string, updated_at string"
SCHEMAS = {
    "papers": f"paper_id string, doi_key string, title_key string, year string, scientific_audit_status string, source_paper_id string, index_json string, record_json string, {_STORED}",
    "claims": f"claim_id string, paper_id string, field_path string, scientific_status string, independent_audit string, row_json string, {_STORED}",
    "markers": f"marker_id string, paper_id string, field_path string, extraction_status string, scientific_status string, independent_audit string, row_json string, {_STORED}",
    "gaps": f"gap_key string, row_json string, {_STORED}",
}
KEYS = {"papers": "paper_id", "claims": "claim_id", "markers": "marker_id", "gaps": "gap_key"}
LOGS = {
    "aliases": "alias_id string, paper_id string, matched_on string, import_run_id string",
    "row_versions": "table_name string, row_key string, fingerprint string, import_run_id string",
    "runs": "run_id string, source_name string, sha256 string, imported_at string, counts_json string, warnings_json string",
}
_MANIFEST = "seq long, run_id string, published_at string, buckets int, parts array<struct<table:string,bucket:int,run:string>>, logs array<struct<table:string,run:string>>"


class Conflict(RuntimeError):
    """Another run was published since the corpus was opened."""


@dataclass(frozen=True)
class Corpus:
    """A corpus as of one manifest row. The manifest has at most tables x buckets entries, and one a log and run."""

    spark: SparkSession
    root: str
    buckets: int
    seq: int = 0
    parts: dict[tuple[str, int], str] = field(default_factory=dict)
    logs: tuple[tuple[str, str], ...] = ()

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def table(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets: no other file is opened."""
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/{run}/{t}/bucket={b}" for (t, b), run in sorted(self.parts.items()) if t == name and (wanted is None or b in wanted)]
        return self._read(SCHEMAS[name], paths)

    def log(self, name: str) -> DataFrame:
        return self._read(LOGS[name], [f"{self.root}/{run}/{t}" for t, run in self.logs if t == name])

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def has_run(self, run_id: str) -> bool:
        return any(run == run_id for _, run in self.logs) or run_id in self.parts.values()

    def publish(self, run_id: str, at: str, tables: dict[str, tuple[DataFrame, Iterable[int]]], logs: dict[str, DataFrame]) -> Corpus:
        """Writes buckets and logs of a run, then its manifest row."""
        parts = dict(self.parts)
        for name, (rows, buckets) in tables.items():
            buckets = sorted(set(buckets))
            if buckets:
                dealt = rows.withColumn("bucket", self.bucket(F.col(KEYS[name]))).hint("rebalance", "bucket")
                dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{run_id}/{name}")
                parts |= {(name, b): run_id for b in buckets}
        for name, rows in logs.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{run_id}/{name}")
        now = (*self.logs, *((name, run_id) for name in logs))
        if open_corpus(self.spark, self.root, self.buckets).seq != self.seq:
            raise Conflict(f"{run_id}: the corpus has changed since it was opened")
        row = [(self.seq + 1, run_id, at, self.buckets, [(t, b, r) for (t, b), r in parts.items()], list(now))]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/_manifest")
        return Corpus(self.spark, self.root, self.buckets, self.seq + 1, parts, now)


def open_corpus(spark: SparkSession, root: str, buckets: int = 64) -> Corpus:
    """The newest published state; a root without a manifest is an empty corpus of ``buckets`` buckets."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return Corpus(spark, root, buckets)
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/_manifest")
    newest = rows.orderBy(F.desc("seq")).first()
    if newest is None:
        return Corpus(spark, root, buckets)
    return Corpus(spark, root, newest["buckets"], newest["seq"], {(p["table"], p["bucket"]): p["run"] for p in newest["parts"]}, tuple((x["table"], x["run"]) for x in newest["logs"]))


# --- import -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Package:
    """paper index, records(paper_id, record_json), claim rows and gap candidates of one workbook."""

    index: DataFrame
    records: DataFrame
    claims: DataFrame
    gaps: DataFrame
    source_name: str
    sha256: str


@dataclass(frozen=True)
class Outcome:
    """``status``: imported, already_imported, planned (dry run), rejected (error rows) or stale (an older package)."""

    status: str
    corpus: Corpus
    counts: DataFrame | None = None
    violations: DataFrame | None = None


def _dated(rows: DataFrame, run_id: str, at: str) -> DataFrame:
    return rows.withColumns({"import_run_id": F.lit(run_id), "created_at": F.lit(at), "updated_at": F.lit(at)})


def _incoming(package: Package, resolved: DataFrame) -> dict[str, DataFrame]:
    """Rows of the package as they would be stored, under the ids of the papers they belong to."""
    content = [c for c in package.index.columns]
    names = resolved.select("paper_id", "target_id", "doi_key", "title_key", F.col("year").alias("_year"))
    rows = package.index.join(names, "paper_id").join(package.records, "paper_id", "left")
    papers = rows.select(
        F.col("target_id").alias("paper_id"), "doi_key", "title_key", F.col("_year").alias("year"), "scientific_audit_status", F.col("paper_id").alias("source_paper_id"),
        F.to_json(F.struct(*sorted(content))).alias("index_json"), "record_json", row_fingerprint(F.struct(F.struct(*sorted(content)).alias("index"), F.col("record_json").alias("record"))).alias("fingerprint"))
    own = package.claims.withColumns({"row_json": F.to_json(F.struct(*sorted(package.claims.columns))), "fingerprint": G.claim_row_fingerprint(package.claims)})
    own = own.join(resolved.select("paper_id", "target_id"), "paper_id").withColumn("paper_id", F.col("target_id"))
    marker = G.is_marker(F.col("extraction_status"))
    gaps = package.gaps.select(F.coalesce(title_key(F.col("candidate_topic")), F.lit("")).alias("gap_key"), F.to_json(F.struct(*sorted(package.gaps.columns))).alias("row_json"), row_fingerprint(F.struct(*sorted(package.gaps.columns))).alias("fingerprint"))
    return {
        "papers": papers,
        "claims": own.filter(~marker).select("claim_id", "paper_id", "field_path", "scientific_status", "independent_audit", "row_json", "fingerprint"),
        "markers": own.filter(marker).select(F.col("claim_id").alias("marker_id"), "paper_id", "field_path", "extraction_status", "scientific_status", "independent_audit", "row_json", "fingerprint"),
        "gaps": gaps,
    }


def _protected(name: str) -> Column:
    if name == "papers":
        recorded = F.get_json_object("record_json", "$.scientific_audit_status")
        return G.is_attested(F.col("scientific_audit_status"), F.lit(None).cast("string")) | G.is_attested(recorded, F.lit(None).cast("string"))
    return F.lit(False) if name == "gaps" else G.is_attested(F.col("scientific_status"), F.col("independent_audit"))


def import_package(corpus: Corpus, package: Package, run_id: str, at: str, *, dry_run: bool = False, allow_revert: bool = False) -> Outcome:
    """Checks a package against its own rules and the corpus, plans every row, and applies the plan as one commit.

    Two papers of a package that turn out to be one stored paper are an error. Stored rows that the package lacks stay as they are.
    """
    spark = corpus.spark
    if corpus.has_run(run_id):
        return Outcome("already_imported", corpus)
    stored = corpus.table("papers")
    resolved = cut_lineage(G.resolve_papers(G.identity_columns(package.index).select("paper_id", "doi_key", "title_key", "year"), stored, corpus.log("aliases")))
    held = G.doi_conflicts(resolved, stored)
    arriving = package.claims.join(resolved.select("paper_id", "target_id"), "paper_id").withColumn("paper_id", F.col("target_id"))
    moved = G.claim_identity(arriving.select("claim_id", "paper_id", "field_path", "extraction_status"), corpus.table("claims"), corpus.table("markers"))
    twice = resolved.groupBy("target_id").agg(F.count("*").alias("n")).filter("n > 1")
    violations = cut_lineage(all_violations([
        G.paper_identity_rules(package.index), G.claim_rules(package.claims, package.index),
        broken(held, "doi_held_by_other", "PAPER_INDEX", F.col("paper_id"), F.col("owner")),
        broken(moved, "claim_identity_changed", "SCIENTIFIC_CLAIMS", F.col("claim_id"), F.col("stored_kind")),
        broken(twice, "paper_target_repeated", "PAPER_INDEX", F.col("target_id")),
        G.type_warnings(package.claims),
    ]))
    if not accepted(violations):
        return Outcome("rejected", corpus, None, violations)

    incoming = _incoming(package, resolved)
    versions = corpus.log("row_versions")
    plans = {}
    for name, key in KEYS.items():
        old = corpus.table(name).select(F.col(key).alias("key"), "fingerprint", _protected(name).alias("protected"))
        known = versions.filter(F.col("table_name") == name).select(F.col("row_key").alias("key"), "fingerprint")
        plans[name] = cut_lineage(G.plan_upsert(incoming[name].select(F.col(key).alias("key"), "fingerprint"), old, known, allow_revert=allow_revert))
    counts = cut_lineage(G.import_counts(plans))  # entities x actions
    plan = G.all_rows(plans, "entity")
    shown = lambda action, rule: broken(plan.filter(F.col("action") == action), rule, "CORPUS", F.concat_ws(":", "entity", "key"), "", "warn")
    warnings = all_violations([violations, shown("skipped_protected", "attested_row_kept"), shown("reverted", "row_reverted")])
    if not counts.filter("action = 'stale'").isEmpty():
        return Outcome("stale", corpus, counts, all_violations([violations, broken(plan.filter("action = 'stale'"), "row_older_than_stored", "CORPUS", F.concat_ws(":", "entity", "key"))]))
    if dry_run:
        return Outcome("planned", corpus, counts, warnings)

    tables = {}
    for name, key in KEYS.items():
        written = plans[name].filter(F.col("action").isin("created", "updated", "reverted")).select(F.col("key").alias(key), "action")
        buckets = [r[0] for r in written.select(corpus.bucket(F.col(key))).distinct().collect()]  # at most the number of buckets
        fresh = _dated(incoming[name], run_id, at)
        tables[name] = (G.apply_upsert(fresh, corpus.table(name, buckets), written, key), buckets)
    logs = {
        "aliases": G.new_aliases(resolved).withColumn("import_run_id", F.lit(run_id)),
        "row_versions": all_versions(corpus, versions, plans, run_id),
        "runs": run_log(spark, counts, run_id, package.source_name, package.sha256, at, warnings),
    }
    return Outcome("imported", corpus.publish(run_id, at, tables, logs), counts, warnings)


def all_versions(corpus: Corpus, versions: DataFrame, plans: dict[str, DataFrame], run_id: str) -> DataFrame:
    """Version rows to append: contents stored before this run or by it that were not known."""
    rows = []
    for name, key in KEYS.items():
        rows.append(G.record_versions(versions, plans[name], name, run_id))
        before = corpus.table(name).select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), "fingerprint", F.lit(run_id).alias("import_run_id"))
        rows.append(before.join(versions.select("table_name", "row_key", "fingerprint"), ["table_name", "row_key", "fingerprint"], "left_anti"))
    return all_violations(rows).dropDuplicates(["table_name", "row_key", "fingerprint"])


def attest(corpus: Corpus, claims: DataFrame, run_id: str, at: str) -> Corpus:
    """Promotes stored claims(claim_id, scientific_status, independent_audit): from then on an import leaves them alone."""
    new = claims.select("claim_id", F.col("scientific_status").alias("_s"), F.col("independent_audit").alias("_a"), F.lit(True).alias("_hit"))
    buckets = [r[0] for r in claims.select(corpus.bucket(F.col("claim_id"))).distinct().collect()]  # at most the number of buckets
    rows = corpus.table("claims", buckets).join(new, "claim_id", "left")
    pick = lambda c, n: F.when(F.col("_hit"), F.col(n)).otherwise(F.col(c)).alias(c)
    changed = {"scientific_status": "_s", "independent_audit": "_a"}
    out = rows.select(*[pick(c, changed[c]) if c in changed else F.when(F.col("_hit"), F.lit(at)).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in corpus.table("claims").columns])
    return corpus.publish(run_id, at, {"claims": (out, set(buckets) & {b for t, b in corpus.parts if t == "claims"})}, {})
