"""Layered models: functions that return DataFrames, with a materialization each.

A model names what it reads; the project runs models after what they read.

    project = Project(spark, root)
    project.source("raw", df)

    @project.model("stg_orders", refs=["raw"], layer="stg")
    def stg_orders(ctx):
        return ctx.ref("raw").distinct()
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from martflow import storage
from martflow.operators.checks import assert_checks
from martflow.operators.merge import merge
from martflow.operators.relational import in_types_of, union_by_name
from martflow.plans.daily import refresh
from martflow.plans.digests import changed_partitions, keep_digests
from martflow.plans.incremental import (
    check_schema,
    incremental_append,
    incremental_merge,
    missing_rows,
)
from martflow.sinks.merging import upsert_path
from martflow.sinks.tables import ensure_database, layout, publish
from martflow.sinks.writers import in_partitions, stored_rows, write_partitions
from martflow.sources.catalog import discover_table, register_partitions

MATERIALIZED = ("view", "table", "ephemeral", "append", "merge", "daily")


@dataclass
class Model:
    name: str
    build: Callable[[Context], DataFrame]
    refs: Sequence[str]
    materialized: str
    layer: str
    ts: str | None = None
    keys: Sequence[str] = ()
    partition_by: Sequence[str] = ()
    sort: Sequence[str] = ()
    cluster: Sequence[str] = ()
    on_schema_change: str = "fail"
    checks: Sequence[Callable[[DataFrame], DataFrame]] = ()
    late: str = "strict"
    options: dict = field(default_factory=dict)


@dataclass
class Context:
    """What a model sees while it is built."""

    project: Project
    model: Model
    is_incremental: bool
    given: Mapping[str, DataFrame] = field(default_factory=dict)

    def ref(self, name: str) -> DataFrame:
        if name not in self.model.refs:
            raise KeyError(f"model {self.model.name} does not declare {name}")
        return self.given.get(name, self.project.frames[name])

    @property
    def this(self) -> DataFrame:
        """The stored rows of the model itself."""
        return self.project.spark.table(self.project.table_name(self.model))


class Project:
    """A set of models over named sources.

    ``view`` and ``ephemeral`` models stay plans (a view also gets a name for SQL
    text); ``table``, ``append`` and ``merge`` are stored under ``root`` and
    registered in one database per layer.  A table published as a whole is laid out
    by ``cluster`` and ``sort``.  An ``append`` or ``merge`` model with
    ``partition_by`` lives in one partitioned folder, and a run rewrites only the
    partitions it touches.

    An ``append`` model with a ``ts`` takes the rows newer than its newest; with
    ``late="all"`` it takes every row it does not have yet, late ones, ones of the same
    instant and ones without a time; if it is partitioned, only partitions that differ from
    the source (see ``plans.digests``) are read and compared.  A ``merge`` model refuses a batch, the first one
    too, that repeats a key, unless its ``options`` say ``on_duplicate="latest"``.
    Checks of a table that is published as a whole run before it becomes visible.

    A ``daily`` model's rows of a partition come from the same partition of its refs that
    are stored with the same ``partition_by``, and from its other refs as a whole.  It is
    built for the partitions whose files have changed since it was last made.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str = ""):
        self.spark, self.root, self.prefix = spark, root, prefix
        self.models: dict[str, Model] = {}
        self.frames: dict[str, DataFrame] = {}
        self._checked = False

    def source(self, name: str, df: DataFrame) -> None:
        self.frames[name] = df

    def model(
        self,
        name: str,
        refs: Sequence[str] = (),
        materialized: str = "view",
        layer: str = "mart",
        **settings,
    ):
        """Decorator that registers a model."""
        if materialized not in MATERIALIZED:
            raise ValueError(f"materialized must be one of {MATERIALIZED}")

        def register(build):
            self.models[name] = Model(name, build, refs, materialized, layer, **settings)
            return build

        return register

    def table_name(self, model: Model) -> str:
        return f"{self.prefix}{model.layer}.{model.name}"

    def order(self, only: Sequence[str] | None = None) -> list[str]:
        """Model names, each after those it reads; optionally just what ``only`` needs."""
        sources = self.frames.keys() - self.models.keys()
        graph = {n: [r for r in m.refs if r not in sources] for n, m in self.models.items()}
        unknown = {r for refs in graph.values() for r in refs} - graph.keys()
        if unknown:
            raise KeyError(f"unknown models or sources: {sorted(unknown)}")
        names = list(TopologicalSorter(graph).static_order())
        if only is None:
            return names
        needed, todo = set(), list(only)
        while todo:
            name = todo.pop()
            if name not in needed:
                needed.add(name)
                todo += graph[name]
        return [n for n in names if n in needed]

    def run(
        self, only: Sequence[str] | None = None, full_refresh: bool = False
    ) -> dict[str, DataFrame]:
        """Build models in order and check each.  Returns their frames."""
        for name in self.order(only):
            model = self.models[name]
            self.frames[name] = self._materialize(model, full_refresh)
            if model.checks and not self._checked:
                self._check(model, self.frames[name])
        return {n: self.frames[n] for n in self.order(only)}

    def _check(self, model: Model, rows: DataFrame) -> None:
        assert_checks([check(rows) for check in model.checks])

    def _first_rows(self, model: Model, rows: DataFrame) -> DataFrame:
        """What a first run of a merge model stores: one row for each key."""
        if model.materialized != "merge":
            return rows
        empty = self.spark.createDataFrame([], rows.drop("Op").schema)
        return merge(empty, rows, model.keys, **model.options)

    def _materialize(self, model: Model, full_refresh: bool) -> DataFrame:
        self._checked = False
        table = self.table_name(model)
        stored = model.materialized in ("table", "append", "merge", "daily")
        if stored:
            db = table.split(".")[0]
            ensure_database(self.spark, db, f"{self.root.rstrip('/')}/{db}")
        there = stored and self.spark.catalog.tableExists(table)
        incremental = there and model.materialized != "table" and not full_refresh
        if model.materialized == "daily":
            self._refresh(model, there and not full_refresh)
            return self.spark.table(table)
        context = Context(self, model, incremental)
        rows = model.build(context)
        if model.materialized == "ephemeral":
            return rows
        if model.materialized == "view":
            rows.createOrReplaceTempView(f"{self.prefix}{model.layer}_{model.name}")
            return rows
        if model.partition_by and model.materialized != "table":
            self._store_partitioned(model, context, rows)
        elif not incremental:
            self._publish(model, self._first_rows(model, rows))
        elif model.materialized == "append":
            self._append(model, context.this, rows)
        else:
            merged = incremental_merge(context.this, rows, model.keys, **model.options)
            self._publish(model, merged)
        return self.spark.table(table)

    def _folder(self, model: Model) -> str:
        return f"{self.root.rstrip('/')}/{self.table_name(model).replace('.', '/')}"

    def _refresh(self, model: Model, there: bool) -> None:
        by, path, table = tuple(model.partition_by), self._folder(model), self.table_name(model)
        facts, others = {}, {}
        for name in model.refs:
            ref = self.models.get(name)
            if ref and tuple(ref.partition_by) == by and ref.materialized in ("append", "merge", "daily"):
                facts[name] = (self._folder(ref), self.frames[name])
            else:
                others[name] = self.frames[name]
        if not there:
            storage.delete(self.spark, path)

        def build(parts: Mapping[str, DataFrame], wholes: Mapping[str, DataFrame]) -> DataFrame:
            return model.build(Context(self, model, there, {**parts, **wholes}))

        done = refresh(self.spark, path, by, build, facts, others)
        if not there or (done and (done["parts"] is None or done["emptied"])):
            discover_table(self.spark, path, table)
        elif done:
            register_partitions(self.spark, table, done["parts"])

    def _publish(self, model: Model, rows: DataFrame) -> None:
        laid_out = layout(rows, model.sort, model.cluster)
        check = (lambda staged: self._check(model, staged)) if model.checks else None
        publish(laid_out, self.table_name(model), self.root, check)
        self._checked = True

    def _store_partitioned(self, model: Model, context: Context, rows: DataFrame) -> None:
        by, table = model.partition_by, self.table_name(model)
        path = self._folder(model)
        if not context.is_incremental:
            write_partitions(self._first_rows(model, rows), path, by, mode="overwrite")
            if model.late == "all":
                stored = stored_rows(self.spark, path)
                keep_digests(stored, path, by, stored.columns)
            discover_table(self.spark, path, table)
        elif model.materialized == "append":
            self._append_partitioned(model, context.this, rows, path)
        else:
            known = [c for c in rows.columns if c in context.this.columns or c == "Op"]
            stored = context.this.schema
            batch = rows.select(*known)
            done = upsert_path(
                self.spark, path, batch, model.keys, by, declared=stored, **model.options
            )
            if done.get("emptied"):
                discover_table(self.spark, path, table)
            else:
                register_partitions(self.spark, table, batch)

    def _append_partitioned(self, model: Model, target: DataFrame, rows: DataFrame, path: str) -> None:
        """Append to a partitioned model.  With ``late="all"`` only partitions whose digest
        is not the source's are compared, and only they are read."""
        by, table = model.partition_by, self.table_name(model)
        if model.late != "all":
            new = self._new_rows(model, target, rows)
            write_partitions(new, path, by, mode="append")
            register_partitions(self.spark, table, new)
            return
        shared = [c for c in target.columns if c in rows.columns]
        ours = in_types_of(rows, target.select(*shared))
        changed = changed_partitions(ours, path, by, shared)
        if changed.isEmpty():
            return
        # The folder is asked, not the catalog, which a lost run may have left behind.
        held = in_partitions(stored_rows(self.spark, path), by, changed)
        new = missing_rows(held.select(*target.columns), in_partitions(ours, by, changed))
        new = check_schema(target, new, model.on_schema_change)
        write_partitions(new, path, by, mode="append")
        now = in_partitions(stored_rows(self.spark, path), by, changed)
        keep_digests(now, path, by, shared)
        if set(new.columns) != set(target.columns):
            self.spark.sql(f"DROP TABLE {table}")  # the files stay; the new columns are read from them
            discover_table(self.spark, path, table)
        else:
            register_partitions(self.spark, table, now)

    def _new_rows(self, model: Model, target: DataFrame, rows: DataFrame) -> DataFrame:
        if model.late == "all":
            rows = missing_rows(target, rows)
        elif model.ts:
            rows = incremental_append(target, rows, model.ts)
        return check_schema(target, rows, model.on_schema_change)

    def _append(self, model: Model, target: DataFrame, rows: DataFrame) -> None:
        new = self._new_rows(model, target, rows)
        table = self.table_name(model)
        if set(new.columns) != set(target.columns):
            publish(union_by_name(target, new, allow_missing=True), table, self.root)
            return
        # Appending adds files to a folder the plan reads its newest time from;
        # the plan has listed that folder before the first file appears.
        new.write.insertInto(table)
