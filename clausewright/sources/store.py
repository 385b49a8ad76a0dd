"""The rule store: append-only Parquet tables with fixed schemas; the latest event of a rule counts.

Parquet has no UPDATE: a status change is a new row of ``rule_events``, and readers take the latest
by time. Ids follow from content, so writing the same thing twice gives the same id.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import severity_rank, truncated_id

SCHEMAS = {
    "policies": "policy_id string, name string, description string, owner_org string, source_file string, status string, version int, created_at timestamp, updated_at timestamp",
    "policy_rules": "rule_id string, policy_id string, title string, description string, applies_to string, predicate string, nl_assertion string, reference_text string, similarity_threshold double, answer_type string, answer_options array<string>, severity string, preferred_language string, walkaway_language string, fallback_language array<string>, escalation_owner string, rationale string, tags array<string>, source_provenance string, status string, version int, created_at timestamp, updated_at timestamp",
    "rule_bindings": "binding_id string, rule_id string, entity_kind string, entity_id string, label_text string, label_embedding array<float>, confidence double",
    "rule_revisions": "revision_id string, rule_id string, revision_no int, diff string, author string, note string, created_at timestamp",
    "rule_evaluations": "eval_id string, run_id string, rule_id string, agreement_id string, outcome string, severity string, answer_value string, deviation double, evidence array<struct<clause_id:string,text:string>>, rationale string, evaluator_used string, evaluated_at timestamp",
    "rule_events": "rule_id string, status string, at timestamp",
}

# What the columns may hold.
SEVERITIES = ("info", "warn", "approval_required", "blocker")
APPLIES_TO = ("document", "domain", "cluster", "field", "composite", "cross_field")
RULE_STATUS = ("draft", "active", "retired")
POLICY_STATUS = ("draft", "published", "archived")
OUTCOMES = ("pass", "fail", "n/a", "needs_human")
ENTITY_KINDS = ("domain", "cluster", "field", "composite")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local master may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """``root`` is a folder that Spark reads and writes; opening it creates missing tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        for name, schema in SCHEMAS.items():
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                spark.createDataFrame([], schema).write.parquet(f"{self.root}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows with the table's columns in any order; missing ones are null."""
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema.fields
        have = set(rows.columns)
        rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)).write.mode("append").parquet(f"{self.root}/{name}")

    def create_policy(self, name: str, description: str = "", owner_org: str = "", source_file: str = "", at: str = "1970-01-01 00:00:00") -> str:
        row = self.spark.range(1).select(
            truncated_id(F.lit("policy"), F.lit(name), F.lit(owner_org), F.lit(source_file)).alias("policy_id"), F.lit(name).alias("name"), F.lit(description).alias("description"),
            F.lit(owner_org).alias("owner_org"), F.lit(source_file).alias("source_file"), F.lit("draft").alias("status"), F.lit(1).alias("version"),
            F.lit(at).cast("timestamp").alias("created_at"), F.lit(at).cast("timestamp").alias("updated_at"),
        )
        self.append("policies", row)
        return row.first().policy_id

    def describe(self, policy_id: str, at: str, description: str | None = None, status: str | None = None) -> None:
        """The policy's next version, a row with another description or status; the latest row counts."""
        if status is not None and status not in POLICY_STATUS:
            raise ValueError(status)
        told = {"description": F.coalesce(F.lit(description), "description"), "status": F.coalesce(F.lit(status), "status")}
        now = self.policy(policy_id).withColumns(told).withColumn("updated_at", F.lit(at).cast("timestamp")).withColumn("version", F.col("version") + 1)
        self.append("policies", now)

    def _latest(self) -> DataFrame:
        got = self.table("policies")
        return got.groupBy("policy_id").agg(F.max_by(F.struct(*got.columns), F.struct("updated_at", "version")).alias("p")).select("p.*")

    def policy(self, policy_id: str) -> DataFrame:
        return self._latest().filter(F.col("policy_id") == policy_id)

    def policies(self, status: str | None = None, archived: bool = True) -> DataFrame:
        got = self._latest()
        if status is not None:
            got = got.filter(F.col("status") == status)
        return (got if archived else got.filter(~F.col("status").eqNullSafe("archived"))).orderBy("name")

    def create_rules(self, rules: DataFrame) -> None:
        """Rules without an id get one from policy, title, predicate and assertion."""
        if "rule_id" not in rules.columns:
            parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rules.columns else F.lit("") for c in ("policy_id", "title", "predicate", "nl_assertion", "source_provenance")]
            rules = rules.withColumn("rule_id", truncated_id(*parts))
        self.append("policy_rules", rules)

    def rules(self, policy_id: str | None = None) -> DataFrame:
        """Rules in their latest version, with their current status, by title."""
        latest = self.table("rule_events").groupBy("rule_id").agg(F.max_by("status", "at").alias("latest"))
        got = self.table("policy_rules")
        if policy_id is not None:
            got = got.filter(F.col("policy_id") == policy_id)
        revised = self.table("rule_revisions").groupBy("rule_id").agg(F.max("revision_no").alias("revised"))
        got = got.join(revised, "rule_id", "left").filter("coalesce(version, 1) = coalesce(revised, coalesce(version, 1))").drop("revised")
        got = got.join(latest, "rule_id", "left").withColumn("status", F.coalesce("latest", "status")).drop("latest")
        return got.orderBy("title", "rule_id")

    def set_status(self, rules: DataFrame, status: str, at: str) -> None:
        """One status event for each rule id in ``rules``: a single one or a whole filtered set."""
        if status not in RULE_STATUS:
            raise ValueError(status)
        self.append("rule_events", rules.select("rule_id", F.lit(status).alias("status"), F.lit(at).cast("timestamp").alias("at")))

    def add_bindings(self, bindings: DataFrame) -> None:
        if "binding_id" not in bindings.columns:
            bindings = bindings.withColumn("binding_id", truncated_id(F.col("rule_id"), F.col("entity_kind"), F.col("entity_id")))
        self.append("rule_bindings", bindings)

    def bindings_for(self, rule_id: str) -> DataFrame:
        return self.table("rule_bindings").filter(F.col("rule_id") == rule_id)

    def record(self, findings: DataFrame, at: str) -> None:
        """All findings of a run in one append."""
        got = findings.withColumn("evaluated_at", F.lit(at).cast("timestamp")).withColumn("evaluator_used", F.to_json("evaluator_used"))
        self.append("rule_evaluations", got.withColumn("eval_id", truncated_id(F.col("run_id"), F.col("agreement_id").cast("string"), F.col("rule_id"))))

    def findings(self, run_id: str) -> DataFrame:
        return self.table("rule_evaluations").filter(F.col("run_id") == run_id).orderBy(severity_rank(F.col("severity")), "agreement_id", "rule_id")

    def latest_evaluations(self, agreement_id: str, k: int = 50) -> DataFrame:
        return self.table("rule_evaluations").filter(F.col("agreement_id") == agreement_id).orderBy(F.desc("evaluated_at"), "eval_id").limit(k)

    def export_rules(self, path: str, policy_id: str | None = None) -> None:
        self.rules(policy_id).write.mode("overwrite").json(path)

    def export_yaml(self, path: str, policy_id: str | None = None) -> None:
        """A YAML document a rule, one text file a partition; JSON values are YAML, so no library is needed."""
        rules = self.rules(policy_id)
        lines = [F.concat(F.lit(f"{c}: "), F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})) - 6)) for c in rules.columns]
        rules.select(F.concat_ws("\n", F.lit("---"), *lines).alias("value")).write.mode("overwrite").text(path)

    def import_yaml(self, path: str) -> DataFrame:
        """The rules of such files, with the rule table's columns."""
        text = self.spark.read.option("lineSep", "---\n").text(path).filter("trim(value) <> ''")
        # Each line is a key and a JSON value: together they are the members of an object.
        members = F.transform(F.filter(F.split("value", "\n"), lambda x: x != ""), lambda x: F.regexp_replace(x, "^([a-z_]+): ", '"$1":'))
        return text.select(F.from_json(F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")), SCHEMAS["policy_rules"]).alias("r")).select("r.*")

    def export_findings(self, path: str, run_id: str) -> None:
        """As CSV; the evidence goes in as JSON."""
        self.findings(run_id).withColumn("evidence", F.to_json("evidence")).write.mode("overwrite").option("header", True).csv(path)


def migrate_benchmarks(benchmarks: DataFrame, policy_id: str) -> DataFrame:
    """One similarity rule per legacy benchmark: threshold one less twice the mean deviation, .5 at least.

    ``benchmarks``: cluster_id, label, benchmark_id, text, mean_dev.
    """
    return benchmarks.select(
        truncated_id(F.lit(policy_id), F.col("cluster_id").cast("string"), F.col("benchmark_id").cast("string")).alias("rule_id"), F.lit(policy_id).alias("policy_id"),
        F.concat(F.col("label").cast("string"), F.lit(" matches the benchmark")).alias("title"), F.lit("cluster").alias("applies_to"), F.lit("info").alias("severity"),
        F.col("text").alias("reference_text"), F.greatest(F.lit(0.5), 1 - 2 * F.coalesce(F.col("mean_dev"), F.lit(0.0))).alias("similarity_threshold"), F.lit("draft").alias("status"),
        F.to_json(F.struct(F.lit("benchmark").alias("migrated_from"), F.col("benchmark_id"))).alias("source_provenance"),
    )
