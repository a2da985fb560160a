"""Optional prose about a scored change: the facts a writer may use, replies as columns, and a plain-text report.

No service is called here: ``narrate`` takes any function from facts to a reply. The prose never
changes a score.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sections of a reply.
SECTIONS = ("summary", "rollout", "rollback_trigger", "monitoring")
DISCLAIMER = "Written from the facts in this payload by a language model; it explains the score and does not affect it."


def facts(doc: dict, most_files: int = 5) -> dict:
    """What a writer sees of a payload, and nothing else."""
    scope, blast = doc.get("scope") or {}, doc.get("blast_radius") or {}
    return {
        "score": doc.get("score", 0), "band": doc.get("band"), "method": doc.get("scoring_method"), "recommendation": doc.get("recommendation"),
        "scope": scope.get("description"), "author": scope.get("author"), "files": scope.get("files_analyzed"), "commits": scope.get("commits_walked"),
        "factors": [{k: r.get(k) for k in ("label", "detail", "path", "points")} for r in doc.get("reasons") or []],
        "riskiest": [{k: f.get(k) for k in ("path", "score", "lines_added", "lines_deleted")} for f in (doc.get("files") or [])[:most_files]],
        "impact": {k: v for k, v in blast.items() if k not in ("per_file", "graph")} if blast.get("analyzed") else None,
    }


def reply_sections(reply: Column) -> Column:
    """struct of the sections: from the reply's JSON object, inside a fence or other prose if need be; else all is summary."""
    inner = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(inner != "", inner), "map<string,string>", {"mode": "PERMISSIVE"})
    usable = parsed.isNotNull() & (F.size(parsed) > 0)
    section = lambda name: F.trim(F.coalesce(F.try_element_at(parsed, F.lit(name)), F.lit("")))
    return F.struct(*(F.when(usable, section(n)).otherwise(F.trim(reply) if n == "summary" else F.lit("")).alias(n) for n in SECTIONS))


def parse_reply(reply: str) -> dict[str, str]:
    """The same for one reply on the driver."""
    start, end = reply.find("{"), reply.rfind("}")
    try:
        found = json.loads(reply[start : end + 1]) if 0 <= start < end else None
    except json.JSONDecodeError:
        found = None
    if not isinstance(found, dict):
        return dict.fromkeys(SECTIONS, "") | {"summary": reply.strip()}
    return {n: str(found[n]).strip() if found.get(n) is not None else "" for n in SECTIONS}


def narrate(doc: dict, writer: Callable[[dict], str], name: str) -> dict:
    """The payload with ``ai_explanation``; a writer that fails leaves the reason there and the score as it was."""
    try:
        told = {"available": True, "generated_by": name, "disclaimer": DISCLAIMER} | parse_reply(writer(facts(doc)))
    except Exception as e:  # noqa: BLE001  prose is optional, whatever went wrong
        told = {"available": False, "skipped_reason": str(e), "generated_by": None, "disclaimer": DISCLAIMER}
    return doc | {"ai_explanation": told}


def report(doc: dict, top_files: int = 10) -> str:
    """The payload as plain text for a terminal."""
    out = [f"{doc.get('score', 0):>3}/100  {str(doc.get('band', 'low')).upper()}  {doc.get('recommendation', '')}"]
    out += [f"  {r['points']:+4d}  {r['label']}: {r['detail']}" + (f"  [{r['path']}]" if r.get("path") else "") for r in doc.get("reasons") or []]
    files = doc.get("files") or []
    out += [f"  {f['score']:>3}  {f['path']}  +{f['lines_added']}/-{f['lines_deleted']}" for f in files[:top_files]]
    if len(files) > top_files:
        out.append(f"  and {len(files) - top_files} more")
    blast = doc.get("blast_radius") or {}
    if blast.get("analyzed"):
        out.append(f"  imported by {blast['direct_count']} file(s), {blast['transitive_count']} more further away")
    return "\n".join(out)
