"""Results as text for readers and as JSON for programs. Inputs are the few rows that a query returns."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict
from datetime import UTC, datetime

from quillspark.errors import EngineError, PathError, QueryError

_ARROW = " › "


def _fenced(text: str) -> str:
    return f"```\n{text.strip()}\n```\n"


def _headings(row: dict, before: str = "\n**Headings:** ") -> str:
    names = row.get("heading_hierarchy") or []
    return before + _ARROW.join(names) if names else ""


def _hits(rows: Sequence[dict], level: str) -> str:
    return "".join(f"{level} Result {i}\n\n**Chunk ID:** `{r['chunk_id']}`\n**Source:** `{r['path']}`{_headings(r)}\n\n{_fenced(r['content'])}\n" for i, r in enumerate(rows, 1))


def _related(rows: Sequence[dict]) -> str:
    mark = lambda r: f" _(cross-source: `{r['source_id']}`)_" if r["cross_source"] else ""
    return "".join(f"- **Depth {r['depth']}** — `{r['path']}` (chunk ID: `{r['chunk_id']}`){mark(r)}\n" for r in rows)


def search_results(rows: Sequence[dict]) -> str:
    return "## Search Results\n\n" + _hits(rows, "###") if rows else "No results found."


def traversal(start: str, rows: Sequence[dict]) -> str:
    return f"## Related Chunks\n\nStarting from chunk `{start}`:\n\n" + _related(rows) if rows else f"No related chunks found from chunk `{start}`."


def sources(rows: Sequence[dict]) -> str:
    if not rows:
        return "No documentation sources registered."
    lines = "".join(f"- **{r['name']}** (`{r['source_id']}`) — kind: `{r['kind']}`, last synced: `{r['synced_at'] or 'never'}`\n" for r in rows)
    return f"## Documentation Sources ({len(rows)} registered)\n\n{lines}"


def chunk(r: dict) -> str:
    return f"## Chunk `{r['chunk_id']}`\n\n**Source:** `{r['source_id']}`\n**Path:** `{r['path']}`{_headings(r)}\n**Position:** {r['position']}\n\n{_fenced(r['content'])}"


def document(path: str, rows: Sequence[dict]) -> str:
    if not rows:
        return f"No chunks found for document `{path}`."
    parts = "".join(f"### Chunk {r['position'] + 1} (ID: `{r['chunk_id']}`){_headings(r, ' — ')}\n\n{_fenced(r['content'])}\n" for r in rows)
    return f"## Document: `{path}`\n\n**Chunks:** {len(rows)}\n\n{parts}"


def research(query: str, hits: Sequence[dict], related: Sequence[dict]) -> str:
    shown = query.strip().replace("\n", " ").replace("\r", "")
    text = f"## Research: {shown}\n\n### Search Results\n\n" + (_hits(hits, "####") or "No results found.\n\n")
    return text + (f"### Related Context\n\n{_related(related)}\n" if related else "")


def status(r: dict) -> str:
    return f"## Database Status\n\n- **Sources:** {r['source_count']}\n- **Chunks:** {r['chunk_count']}\n- **Schema version:** {r['schema_version']}\n"


def reply(result: object, request_id: object = 1) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": request_id, "result": result}, ensure_ascii=False)


def failure(error: EngineError, request_id: object = 1) -> str:
    kind = "invalid request" if isinstance(error, PathError | QueryError) else "failure"
    return json.dumps({"jsonrpc": "2.0", "id": request_id, "error": {"code": error.code, "message": f"{kind}: {error}"}}, ensure_ascii=False)


# Cycles


def iso_time(seconds: float) -> str:
    """Seconds since 1970 as a UTC time."""
    return datetime.fromtimestamp(int(seconds), UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def file_size(n: int) -> str:
    """Whole bytes, or tenths (rounded down) of the largest unit that fits."""
    for unit, power in (("GiB", 30), ("MiB", 20), ("KiB", 10)):
        if n >> power:
            return f"{n >> power}.{(n & (1 << power) - 1) * 10 >> power} {unit}"
    return f"{n} B"


def duration(ms: int) -> str:
    seconds, rest = divmod(ms, 1000)
    if seconds < 60:
        return f"{seconds}.{rest:03}s" if seconds else f"{ms}ms"
    minutes, seconds = divmod(seconds, 60)
    return f"{minutes // 60}h{minutes % 60:02}m{seconds:02}s" if minutes >= 60 else f"{minutes}m{seconds:02}s"


def percent(current: int, total: int) -> int:
    return 100 * current // total if total else 0


def metrics(found) -> str:
    """The figures of a cycle as one JSON line."""
    return json.dumps(asdict(found), ensure_ascii=False)


def prewarm_record(found, sources_count: int, now: float) -> str:
    """The JSON line that tells that a first load has ended."""
    done = found.added + found.modified
    payload = {"files_total": done + found.unchanged, "files_synced": done - len(found.errors), "chunks_created": found.chunks, "duration_ms": found.duration_ms, "sources_count": sources_count}
    return json.dumps({"event_type": "prewarm.complete", "timestamp": iso_time(now), "payload": payload})


def exit_code(outcome) -> int:
    """0: all went well, 1: some files or sources did not, 2: nothing could be done (``outcome`` is what was raised)."""
    return 2 if isinstance(outcome, Exception) else outcome.exit_code
