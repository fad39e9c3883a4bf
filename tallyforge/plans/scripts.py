"""SQL scripts: statements in order with named parameters, all of them or none; and folders of queries found by their names."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: What a semicolon may stand in without ending a statement: strings, quoted names, comments.
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^'\"`;/-]+|.", re.DOTALL)
_NAME = re.compile(r"`([^`]+)`|([A-Za-z_]\w*)")
#: Statements that change a table in place: the script works on a copy of it.
_CHANGES = re.compile(r"\s*(?:insert\s+(?:into|overwrite)(?:\s+table)?|truncate\s+table|alter\s+table|drop\s+table(?:\s+if\s+exists)?)\s+`?(\w+)`?(?=[\s(;]|$)", re.IGNORECASE)


class SqlExecutionError(RuntimeError):
    def __init__(self, source: str, index: int, statement: str, cause: Exception):
        super().__init__(f"{source}, statement {index}: {type(cause).__name__}: {cause}")
        self.source, self.index, self.statement, self.cause = source, index, statement, cause


def split_statements(text: str) -> list[str]:
    """Statements without their semicolons; those of comments and blanks only are left out."""
    out, now, bare = [], [], False
    for m in _TOKEN.finditer(text + "\n;"):
        t = m[0]
        if t == ";":
            if bare:
                out.append("".join(now).strip())
            now, bare = [], False
        else:
            now.append(t)
            bare = bare or not (t.startswith(("--", "/*")) or t.isspace())
    return out


def bare(statement: str) -> str:
    """A statement without comments and strings, for looking at its words."""
    return "".join(t if not t.startswith(("--", "/*", "'", '"')) else " " for t in (m[0] for m in _TOKEN.finditer(statement)))


def bound(spark: SparkSession, statement: str, args: dict | None) -> DataFrame:
    """Values come as named parameters (`:run_id`), never pasted into the text; those that a statement does not name are left out."""
    text = bare(statement)
    return spark.sql(statement, args={n: v for n, v in (args or {}).items() if re.search(rf":{n}\b", text)})


def run_text(spark: SparkSession, text: str, source: str = "<text>", args: dict | None = None) -> list[DataFrame]:
    """Each statement's result. If one fails, the error says which, and nothing of the script remains.

    Statements run in a namespace of their own, in a session of their own, where the tables of the current namespace are seen as
    views; a table that a statement changes is copied there first. When all have run, tables made or copied are written beside
    those of their names and then take their places by renaming, dropped ones go, and temporary views come to the caller's session. Tables named with their namespace are
    outside of this.
    """
    statements = split_statements(text)
    if not statements:
        return []
    target, scratch = spark.catalog.currentDatabase(), f"script_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE `{scratch}`")
    inner, ready = spark.newSession(), []
    try:
        for k, v in spark.conf.getAll.items():
            if k.startswith("spark.sql.") and inner.conf.isModifiable(k):
                inner.conf.set(k, v)
        before = {v.name: spark.table(v.name) for v in spark.catalog.listTables() if v.isTemporary}
        for name in before:
            _share_view(spark, inner, name)
        shared = {t.name for t in spark.catalog.listTables(target) if not t.isTemporary}
        for name in shared:
            inner.sql(f"CREATE TEMPORARY VIEW `{name}` AS SELECT * FROM `{target}`.`{name}`")
        inner.sql(f"USE `{scratch}`")
        out, copied = [], set()
        for k, statement in enumerate(statements, 1):
            try:
                if (m := _CHANGES.match(bare(statement))) and (name := m[1].lower()) in shared:
                    inner.sql(f"DROP VIEW IF EXISTS `{name}`")
                    inner.sql(f"CREATE TABLE `{scratch}`.`{name}` USING parquet AS SELECT * FROM `{target}`.`{name}`")
                    shared.discard(name)
                    copied.add(name)
                if m := re.match(r"\s*create\s+(?:or\s+replace\s+)?table\s+(?:if\s+not\s+exists\s+)?`?(\w+)`?", bare(statement), re.IGNORECASE):
                    if m[1].lower() in shared and re.search(r"if\s+not\s+exists", bare(statement), re.IGNORECASE):
                        out.append(inner.sql("SELECT 1 AS skipped WHERE false"))
                        continue
                    if m[1].lower() in shared and not re.match(r"\s*create\s+or", bare(statement), re.IGNORECASE):
                        raise ValueError(f"table {m[1]} is there already")
                out.append(bound(inner, statement, args))
            except Exception as e:
                raise SqlExecutionError(source, k, statement, e) from e
        made = {t.name for t in inner.catalog.listTables(scratch) if not t.isTemporary}
        for v in inner.catalog.listTables():
            if v.isTemporary and v.name not in shared and v.name not in before:
                _share_view(inner, spark, v.name)
        for name in sorted(made):  # what may still fail comes before anything is replaced
            ready.append(f"{scratch}_{name}")
            spark.sql(f"CREATE TABLE `{target}`.`{ready[-1]}` LIKE `{scratch}`.`{name}`")
            spark.sql(f"INSERT INTO `{target}`.`{ready[-1]}` SELECT * FROM `{scratch}`.`{name}`")
        for name in sorted(copied | made):
            spark.sql(f"DROP TABLE IF EXISTS `{target}`.`{name}`")
            if name in made:
                spark.sql(f"ALTER TABLE `{target}`.`{scratch}_{name}` RENAME TO `{target}`.`{name}`")
                ready.remove(f"{scratch}_{name}")
        return out
    finally:
        for name in ready:
            spark.sql(f"DROP TABLE IF EXISTS `{target}`.`{name}`")
        spark.sql(f"DROP DATABASE `{scratch}` CASCADE")


def _share_view(giver: SparkSession, taker: SparkSession, name: str) -> None:
    """Make a temporary view of one session known in another one of the same application."""
    plan = giver.table(name)._jdf.queryExecution().analyzed()
    DataFrame(taker._jvm.org.apache.spark.sql.classic.Dataset.ofRows(taker._jsparkSession, plan), taker).createOrReplaceTempView(name)


def run_file(spark: SparkSession, path: str | Path, args: dict | None = None) -> list[DataFrame]:
    return run_text(spark, Path(path).read_text(encoding="utf-8"), str(path), args)


def sql_files(folder: str | Path) -> dict[str, Path]:
    """*.sql files of a folder by their names without the ending, sorted. A folder that is missing or has none is an error."""
    files = {f.stem: f for f in sorted(Path(folder).glob("*.sql"))}
    if not files:
        raise FileNotFoundError(f"no .sql files in {folder}")
    return files


def run_folder(spark: SparkSession, folder: str | Path, args: dict | None = None) -> list[str]:
    """All *.sql files by name, one script each; the names."""
    files = sql_files(folder).values()
    for f in files:
        run_file(spark, f, args)
    return [f.name for f in files]


def uses(statement: str, names: set[str]) -> set[str]:
    """Which of the names a query mentions."""
    return {n for m in _NAME.finditer(bare(statement)) if (n := m[1] or m[2]) in names}


def ordered(queries: dict[str, str], wanted: str) -> list[str]:
    """The queries that `wanted` needs, itself last: each after those that it mentions. A circle is an error."""
    out, path = [], []

    def add(name: str) -> None:
        if name in path:
            raise ValueError(f"queries need each other: {' -> '.join([*path[path.index(name) :], name])}")
        if name not in out:
            path.append(name)
            for n in sorted(uses(queries[name], set(queries) - {name})):
                add(n)
            path.pop()
            out.append(name)

    add(wanted)
    return out
