"""A tool server: JSON-RPC 2.0, one message a line on standard input and output, a tool for every registered query.

    python -m loomgraph.server FOLDER
"""

from __future__ import annotations

import difflib
import json
import sys
from collections.abc import Callable

from .operators.items import clamped

#: Fixed values of the protocol: its versions, error codes; rows of a reply.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
ROWS, MOST = 50, 1000


class Server:
    """Answers requests; queries are looked up by name and run on demand."""

    def __init__(self, spark, folder: str, queries: dict[str, Callable]):
        self.spark, self.folder, self.queries = spark, folder, queries

    def tools(self) -> list[dict]:
        schema = {"type": "object", "properties": {"limit": {"type": "integer", "minimum": 1, "maximum": MOST}, "fields": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}
        return [{"name": n, "description": (q.__doc__ or f"Rows of {n}.").strip(), "inputSchema": schema} for n, q in sorted(self.queries.items())]

    def call(self, name: str, arguments: dict) -> dict:
        from .operators.export import formatted

        if name not in self.queries:
            near = difflib.get_close_matches(name, self.queries, 1)
            raise LookupError(f"no tool {name}" + (f"; did you mean {near[0]}?" if near else ""))
        unknown = set(arguments) - {"limit", "fields"}
        if unknown:
            raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
        limit = min(MOST, clamped(int(arguments.get("limit", ROWS))))
        rows = json.loads(formatted(self.queries[name](self.spark, self.folder), "compact", arguments.get("fields"), limit + 1))
        data = {"ok": True, "data": rows[:limit], "truncated": len(rows) > limit}
        return {"content": [{"type": "text", "text": json.dumps(data, ensure_ascii=False)}], "structuredContent": data, "isError": False}

    def handle(self, line: str) -> str | None:
        """The reply to one message, or none to a notification."""
        try:
            request = json.loads(line)
        except ValueError:
            return self._error(None, PARSE, "not JSON")
        if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
            return self._error(request.get("id") if isinstance(request, dict) else None, INVALID, "not a request")
        if "id" not in request:
            return None
        params, method = request.get("params") or {}, request["method"]
        if method == "initialize":
            asked = params.get("protocolVersion")
            result = {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": "0.2"}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": self.tools()}
        elif method == "tools/call":
            try:
                result = self.call(str(params.get("name")), params.get("arguments") or {})
            except (LookupError, ValueError, TypeError) as e:
                return self._error(request["id"], BAD_PARAMS, str(e))
            except Exception as e:  # a failed query is a result that says so, not the server's end
                result = {"content": [{"type": "text", "text": str(e)[:2000]}], "isError": True}
        else:
            return self._error(request["id"], NO_METHOD, f"no method {method}")
        return json.dumps({"jsonrpc": "2.0", "id": request["id"], "result": result}, ensure_ascii=False)

    @staticmethod
    def _error(id_, code: int, message: str) -> str:
        return json.dumps({"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}})


def main() -> None:
    from pyspark.sql import SparkSession

    from .plans import catalog

    if len(sys.argv) != 2:
        sys.exit("usage: python -m loomgraph.server FOLDER")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    server = Server(spark, sys.argv[1], catalog.queries())
    for line in sys.stdin:
        if line.strip() and (reply := server.handle(line)) is not None:
            print(reply, flush=True)


if __name__ == "__main__":
    main()
