"""What an agent can ask of a store: tools and resources with their schemas, as plain dictionaries, and JSON-RPC messages.

There is no transport here: a caller passes messages in and sends the answers on, in a process that has the Spark session.
"""

from __future__ import annotations

import hmac
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngramError, NotFoundError, ValidationError
from ..operators import search
from ..schema import CREATE, MemoryType, SearchType
from .store import MemoryStore

KINDS = {"type": "string", "enum": [t.value for t in MemoryType]}
TEXT, TEXTS, WHOLE, UNIT, FLAG = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer", "minimum": 0}, {"type": "number", "minimum": 0, "maximum": 1}, {"type": "boolean"}
FILTERS = {"memory_type": KINDS, "tags": TEXTS, "importance_min": UNIT, "importance_max": UNIT}
EXTRACTION = {
    "type": "object",
    "properties": {
        "entities": {"type": "array", "items": {"type": "object", "properties": {"name": TEXT, "entity_type": TEXT, "description": TEXT}, "required": ["name"]}},
        "relationships": {"type": "array", "items": {"type": "object", "properties": {"source": TEXT, "target": TEXT, "relationship_type": TEXT, "strength": UNIT}, "required": ["source", "target"]}},
    },
}
PYTHON = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def check(value, schema: dict, place: str = "arguments") -> None:
    """A value against the part of JSON Schema that the tools use; the first breach is an error that names its place."""
    kind = schema["type"]
    if not isinstance(value, PYTHON[kind]) or (kind != "boolean" and isinstance(value, bool)):
        raise ValidationError(f"{place} must be of type {kind}")
    if "enum" in schema and value not in schema["enum"]:
        raise ValidationError(f"{place} must be one of {schema['enum']}")
    if kind in ("integer", "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        raise ValidationError(f"{place} is out of bounds")
    if kind == "array":
        for i, x in enumerate(value):
            check(x, schema["items"], f"{place}[{i}]")
    if kind == "object":
        if missing := [k for k in schema.get("required", ()) if k not in value]:
            raise ValidationError(f"{place} lacks {missing[0]}")
        if unknown := [k for k in value if k not in schema["properties"]]:
            raise ValidationError(f"{place} has no {unknown[0]}")
        for k, x in value.items():
            check(x, schema["properties"][k], f"{place}.{k}")


def plain(df: DataFrame) -> list[dict]:
    """Rows of a bounded result as values that JSON has."""
    return [json.loads(r) for r in df.toJSON().collect()]


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    arguments: dict[str, dict]
    required: tuple[str, ...]
    run: Callable[[MemoryStore, dict, int], dict]

    def schema(self) -> dict:
        return {"type": "object", "properties": self.arguments, "required": list(self.required)}


def _store(store: MemoryStore, args: dict, now: int) -> dict:
    spark, id_ = store.tables.memories.sparkSession, str(uuid.uuid4())
    numeric = store._kind().typeName() != "string"
    if numeric:
        id_ = str(uuid.uuid4().int >> 65)
    asked = spark.read.schema(CREATE).json(spark.sparkContext.parallelize([json.dumps(args | {"id": id_})], 1))
    bad = store.create(asked, now).select("errors").first()
    if bad is not None:
        raise ValidationError(", ".join(bad["errors"]))
    store.queue.offer(int(id_) if numeric else id_)
    return {"memory_id": id_}


def _search(store: MemoryStore, args: dict, now: int) -> dict:
    f = dict(args.get("filters", {}))
    where = {"memory_type": f.get("memory_type"), "tags": f.get("tags"), "min_importance": f.get("importance_min"), "max_importance": f.get("importance_max")}
    found = store.search(args["query"], SearchType(args.get("search_type", "hybrid")), related_to=args.get("related_to"), limit=args.get("limit", 10), **where)
    results = plain(found.join(search.summaries(store.tables.memories), "id").orderBy(F.desc("score"), "id"))
    return {"results": results, "results_count": len(results)}


def _get(store: MemoryStore, args: dict, now: int) -> dict:
    store.recall(args["memory_id"], now)
    row = store.get(args["memory_id"])
    return {"memory": plain(row if args.get("include_connections") else row.drop("connections"))[0]}


def _update(store: MemoryStore, args: dict, now: int) -> dict:
    patch = {k: v for k, v in args.items() if k != "memory_id"}
    if not patch:
        raise ValidationError("a field to update is required")
    _known(store, args["memory_id"])
    kinds = {"content": "string", "tags": "array<string>", "importance": "double", "source": "string"}
    patches = store.tables.memories.sparkSession.createDataFrame([(str(args["memory_id"]), *patch.values())], ", ".join(["id string", *(f"{k} {kinds[k]}" for k in patch)]))
    with store.locks.of(args["memory_id"]):
        store.update(patches.withColumn("id", F.col("id").cast(store._kind())), now)
    if "content" in patch:
        store.queue.offer(args["memory_id"])
    return {"memory_id": args["memory_id"], "updated_fields": sorted(patch)}


def _known(store: MemoryStore, id_) -> None:
    if not store.exists(id_):
        raise NotFoundError(f"no record {id_}")


def _delete(store: MemoryStore, args: dict, now: int) -> dict:
    _known(store, args["memory_id"])
    hard = args.get("hard_delete", False)
    ids = store.tables.memories.sparkSession.range(1).select(F.lit(args["memory_id"]).cast(store._kind()).alias("id"))
    store.delete(ids, now, hard)
    return {"memory_id": args["memory_id"], "deleted": "hard" if hard else "soft"}


def _related(store: MemoryStore, args: dict, now: int) -> dict:
    found = plain(store.related(args["memory_id"], args.get("depth", 1), limit=args.get("limit", 10)))
    return {"related": found, "results_count": len(found)}


def _promote(store: MemoryStore, args: dict, now: int) -> dict:
    store.promote(args["memory_id"], now)
    return {"memory_id": args["memory_id"], "memory_type": MemoryType.LONG.value}


def _recent(store: MemoryStore, args: dict, now: int) -> dict:
    rows = store.tables.memories
    if "memory_type" in args:
        rows = rows.filter(F.col("memory_type") == args["memory_type"])
    found = plain(search.recent(rows, min(args.get("limit", 10), search.MAX_LIMIT), args.get("sort_by", "created_at")))
    return {"memories": found, "count": len(found)}


_ID = {"memory_id": TEXT}
# The names of tools, arguments and resources that agents know.
TOOLS = {
    t.name: t
    for t in (
        Tool(
            "store_memory", "Keep a text; records like it are linked to it later.",
            {"content": TEXT, "memory_type": KINDS, "tags": TEXTS, "importance": UNIT, "emotional_valence": {"type": "number", "minimum": -1, "maximum": 1}, "arousal": UNIT, "health": {"type": "number", "minimum": 0, "maximum": 100}, "ttl": WHOLE, "source": TEXT, "graph_extraction": EXTRACTION},
            ("content",), _store,
        ),
        Tool("search_memories", "Find records by meaning, by words, or by both; neighbours of a record can be favoured.", {"query": TEXT, "search_type": {"type": "string", "enum": [t.value for t in SearchType]}, "limit": WHOLE, "related_to": TEXT, "filters": {"type": "object", "properties": FILTERS}}, ("query",), _search),
        Tool("get_memory", "Recall one record.", {**_ID, "include_connections": FLAG}, ("memory_id",), _get),
        Tool("update_memory", "Change fields of a record.", {**_ID, "content": TEXT, "tags": TEXTS, "importance": UNIT, "source": TEXT}, ("memory_id",), _update),
        Tool("delete_memory", "Archive a record, or remove it for good.", {**_ID, "hard_delete": FLAG}, ("memory_id",), _delete),
        Tool("find_related", "Records that connections lead to.", {**_ID, "depth": WHOLE, "limit": WHOLE}, ("memory_id",), _related),
        Tool("promote_to_longterm", "Make a short-term record a long-term one.", _ID, ("memory_id",), _promote),
        Tool("list_recent_memories", "The newest records, or those used last.", {"limit": WHOLE, "memory_type": KINDS, "sort_by": {"type": "string", "enum": ["created_at", "accessed_at"]}}, (), _recent),
    )
}
RESOURCES = {
    "memory://stats": "Counts of records and connections, mean importance",
    "memory://collections/recent": "The newest records; ?limit and ?offset",
    "memory://collections/important": "Records by importance; ?limit and ?offset",
}


def call(store: MemoryStore, name: str, arguments: dict | None = None, now_ms: int | None = None) -> dict:
    """The result of a tool, with `success`; an error of the library is a result as well."""
    try:
        if name not in TOOLS:
            raise NotFoundError(f"no tool {name}")
        check(arguments or {}, TOOLS[name].schema())
        return {"success": True, **TOOLS[name].run(store, arguments or {}, int(time.time() * 1000) if now_ms is None else now_ms)}
    except EngramError as e:
        return {"success": False, "error": type(e).__name__, "status": e.status, "retry": e.retry, "message": str(e)}


def read(store: MemoryStore, uri: str):
    """What a resource holds; memory://graph/{id} is what connections of that record lead to."""
    path, _, query = uri.partition("?")
    asked = dict(parse_qsl(query))
    try:
        limit, offset, depth = (int(asked.get(k, d)) for k, d in (("limit", 10), ("offset", 0), ("depth", 2)))
    except ValueError:
        raise ValidationError(f"{uri} has a parameter that is no number") from None
    if path == "memory://stats":
        return plain(store.stats())[0]
    if path in RESOURCES:
        last = offset + min(limit, search.MAX_LIMIT)
        rows = plain(store.recent(last) if path.endswith("recent") else store.important(last))[offset:]
        return {"memories": rows, "pagination": {"limit": limit, "offset": offset, "count": len(rows)}}
    if path.startswith("memory://graph/"):
        return {"related": plain(store.related(path.removeprefix("memory://graph/"), depth, limit=50))}
    raise NotFoundError(f"no resource {uri}")


def handle(store: MemoryStore, message: dict) -> dict | None:
    """The answer to a JSON-RPC message; None for a notification, which has no id."""
    if "id" not in message:
        return None
    answer, params = {"jsonrpc": "2.0", "id": message["id"]}, message.get("params") or {}
    as_text = lambda x: json.dumps(x, default=str)
    try:
        match message.get("method"):
            case "initialize":
                result = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "engram", "version": "1"}}
            case "ping":
                result = {}
            case "tools/list":
                result = {"tools": [{"name": t.name, "description": t.about, "inputSchema": t.schema()} for t in TOOLS.values()]}
            case "tools/call":
                result = {"content": [{"type": "text", "text": as_text(call(store, params.get("name"), params.get("arguments")))}]}
            case "resources/list":
                result = {"resources": [{"uri": u, "name": u.rpartition("/")[2], "description": d, "mimeType": "application/json"} for u, d in RESOURCES.items()]}
            case "resources/read":
                result = {"contents": [{"uri": params.get("uri"), "mimeType": "application/json", "text": as_text(read(store, str(params.get("uri"))))}]}
            case method:
                return answer | {"error": {"code": -32601, "message": f"no method {method}"}}
    except Exception as e:
        return answer | {"error": {"code": -32602 if isinstance(e, ValidationError) else -32603, "message": str(e)[:500]}}
    return answer | {"result": result}


class Gate:
    """Who may send messages, and how many: a token that is compared in constant time, and a bucket of `burst` messages per client that fills at `per_s`."""

    def __init__(self, token: str | None = None, per_s: float = 50.0, burst: int = 100, clock: Callable[[], float] = time.monotonic, most: int = 10_000):
        self.token, self.per_s, self.burst, self.clock, self.most = token, per_s, burst, clock, most
        self._left: dict[str, tuple[float, float]] = {}

    def admit(self, client: str, token: str | None = None) -> str | None:
        """None if the message may pass, else why not: `unauthorized` or `rate_limited`."""
        if self.token is not None and not hmac.compare_digest((token or "").encode(), self.token.encode()):
            return "unauthorized"
        now = self.clock()
        left, at = self._left.get(client, (float(self.burst), now))
        left = min(self.burst, left + (now - at) * self.per_s)
        if len(self._left) >= self.most:  # full buckets need not be remembered
            self._left = {c: (n, t) for c, (n, t) in self._left.items() if n + (now - t) * self.per_s < self.burst}
        self._left[client] = (left - 1, now) if left >= 1 else (left, now)
        return None if left >= 1 else "rate_limited"
