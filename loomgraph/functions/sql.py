"""SQL over a corpus: one read-only statement, within limits, with hints where names or values aren't there."""

from __future__ import annotations

import difflib
import re
import threading

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, characters of a cell, bytes of a result, seconds (and the most that may be asked for), values of a column that are listed.
ROWS, CELL, BYTES, SECONDS, MOST_SECONDS, VALUES = 200, 4096, 1 << 20, 5.0, 600.0, 100


def assert_read(spark: SparkSession, sql: str) -> str:
    """The statement, if Spark's parser sees one query in it and nothing that writes, sets or describes."""
    text = sql.lstrip("﻿").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise ValueError(f"not a single statement that can be read: {e.getCondition()}") from e
    jvm = spark._jvm
    kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{n}") for n in ("Command", "ParsedStatement")]
    explain = jvm.java.lang.Class.forName("org.apache.spark.sql.execution.command.ExplainCommand")
    todo = [plan.logicalPlan() if explain.isInstance(plan) else plan]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            raise ValueError(f"{node.nodeName()} is not allowed, only queries are")
        for group in (node.children(), node.innerChildren()):
            todo += [x for i in range(group.size()) if (x := group.apply(i)) is not None and hasattr(x, "innerChildren")]
    return text.rstrip().rstrip(";")


def hints(spark: SparkSession, tables: dict[str, DataFrame], error: AnalysisException) -> str:
    """What the name that couldn't be resolved is likely to mean."""
    params = error.getMessageParameters() or {}
    name = (params.get("relationName") or params.get("objectName") or "").replace("`", "").split(".")[-1]
    known = list(tables) if "relationName" in params else sorted({c for df in tables.values() for c in df.columns})
    near = difflib.get_close_matches(name, known, 3)
    return f"{error.getCondition()}: {name}" + (f"; did you mean {', '.join(near)}?" if near else f"; there is {', '.join(known[:20])}")


def run(spark: SparkSession, tables: dict[str, DataFrame], sql: str, limit: int = ROWS, cell: int = CELL, most_bytes: int = BYTES, seconds: float = SECONDS, repo: str = "") -> dict:
    """columns, rows (by position, as names may repeat), truncated, warnings of a read-only statement over the tables.

    Rows are filtered by repository after the limit, so truncation speaks of what the statement gave. The statement's jobs are
    cancelled at the deadline.
    """
    text = assert_read(spark, sql)
    session = spark.newSession()  # its temporary views are nobody else's
    for name, df in tables.items():
        df.createOrReplaceGlobalTempView(f"sql_{name}")
        session.table(f"global_temp.sql_{name}").createOrReplaceTempView(name)
    try:
        found = session.sql(text)
    except AnalysisException as e:
        raise ValueError(hints(spark, tables, e)) from e
    columns = found.columns
    unique = [f"c{i}" for i in range(len(columns))]
    rows = found.toDF(*unique).limit(max(1, limit) + 1)
    got = _collect(session, rows, min(max(seconds, 0.1), MOST_SECONDS))
    truncated, out, size = len(got) > limit, [], 0
    at = columns.index("repo") if repo and "repo" in columns else None
    for r in got[:limit]:
        if at is not None and (r[at] or "").lower() != repo.lower():
            continue
        values = [v[:cell] if isinstance(v, str) else v for v in r]
        size += sum(len(str(v).encode()) for v in values)
        if size > most_bytes:
            truncated = True
            break
        out.append(values)
    return {"columns": columns, "rows": out, "truncated": truncated, "warnings": out_of_vocabulary(tables, text) if not out else []}


def _collect(session: SparkSession, rows: DataFrame, seconds: float) -> list:
    """The rows, or TimeoutError. The statement runs in a thread of its own under a tag, which is cancelled until it ends."""
    result: dict[str, object] = {}
    tag = f"sql-{threading.get_ident()}-{id(rows)}"

    def work() -> None:
        session.addTag(tag)
        try:
            result["rows"] = rows.collect()
        except Exception as e:  # handed to the caller
            result["error"] = e
        finally:
            session.removeTag(tag)

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        for _ in range(20):
            session.interruptTag(tag)
            session.sparkContext.cancelJobsWithTag(tag)
            thread.join(0.5)
            if not thread.is_alive():
                break
        raise TimeoutError(f"no result within {seconds:g} s")
    if "error" in result:
        raise result["error"]  # type: ignore[misc]
    return result["rows"]  # type: ignore[return-value]


def out_of_vocabulary(tables: dict[str, DataFrame], sql: str) -> list[str]:
    """For each comparison `column = 'value'` with a column of few values: a note if the value isn't one of them."""
    notes = []
    for column, value in re.findall(r"(?i)\b([a-z_]\w*)\s*=\s*'((?:[^']|'')*)'", sql):
        for name, df in tables.items():
            if column.lower() in (c.lower() for c in df.columns) and dict(df.dtypes).get(column) == "string":
                known = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(VALUES + 1).collect()]
                if len(known) <= VALUES and value.replace("''", "'") not in known:
                    near = difflib.get_close_matches(value, known, 3)
                    notes.append(f"{name}.{column} is never '{value}'" + (f"; near: {', '.join(near)}" if near else ""))
    return notes


#: What the columns mean that their names don't say.
NOTES = {"items": {"merged": "null unless merged; there is no state `merged`", "created": "seconds since 1970"}, "edges": {"src": "text, also of item numbers; `owner/name#n` of another repository", "source": "the stream that reported the edge"}}


def schema(tables: dict[str, DataFrame], name: str | None = None) -> list[dict]:
    """Columns, types and notes of one table or of all."""
    if name is not None and name not in tables:
        raise ValueError(f"no table {name}; there is {', '.join(sorted(tables))}")
    return [{"table": t, "column": f.name, "type": f.dataType.simpleString(), "note": NOTES.get(t, {}).get(f.name, "")} for t, df in sorted(tables.items()) if name in (None, t) for f in df.schema.fields]
