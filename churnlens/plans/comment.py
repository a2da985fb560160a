"""A payload as a Markdown comment for a review, and the gate on its score.

A comment is a list of parts, each made from the payload's own fields by one function; parts with nothing
to say are left out. What the scorer saw comes first, generated prose last and folded.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

#: Finds an earlier comment, so that it is replaced and not repeated.
MARKER = "<!-- churnlens-report -->"
SIGNS = {"low": "🟢", "medium": "🟡", "high": "🔴"}
#: Parts of a narrative, in order.
PROSE = {"summary": "What makes it risky", "rollout": "How to ship it", "rollback_trigger": "When to take it back", "monitoring": "What to watch"}


def exceeds(payload: dict, threshold: int) -> bool:
    return int(payload.get("score", 0)) >= threshold


def _code(name: str) -> str:
    return f"`{name}`"


def _listed(names: list[str]) -> str:
    return ", ".join(map(_code, names))


def _fold(title: str, body: list[str]) -> str:
    return "\n".join(["<details>", f"<summary>{title}</summary>", "", *body, "", "</details>"])


class Comment:
    def __init__(self, payload: dict, threshold: int, most_reasons: int, most_files: int):
        self.payload, self.threshold, self.most_reasons, self.most_files = payload, threshold, most_reasons, most_files
        self.scope = payload.get("scope") or {}
        self.by_model = payload.get("scoring_method") == "model"
        self.blast = payload.get("blast_radius") or {}

    def verdict(self) -> Iterator[str]:
        band = str(self.payload.get("band") or "low")
        yield f"# {SIGNS.get(band, '⚪')} Change risk: {self.payload.get('score', 0)} of 100, {band}"
        if self.payload.get("recommendation"):
            yield f"> {self.payload['recommendation']}"
        if exceeds(self.payload, self.threshold):
            yield f"⛔ This reaches the gate, which is set to {self.threshold}."

    def warnings(self) -> Iterator[str]:
        found = [f"- ⚠️ {w}" for w in self.payload.get("warnings") or []]
        if found:
            yield "\n".join(found)

    def basis(self) -> Iterator[str]:
        facts = [f"{self.scope.get('files_analyzed', 0)} files in scope"]
        if self.by_model:
            rows = (self.scope.get("model") or {}).get("rows")
            facts.append(f"scored by a model fitted on {rows:,} commits" if rows else "scored by a fitted model")
        else:
            facts.append("scored by rules, with limits from " + ("this repository's percentiles" if self.scope.get("relative_thresholds") else "the settings"))
        skipped = self.scope.get("commits_skipped")
        if skipped:
            facts.append(f"{skipped} commits unreadable")
        yield "; ".join(facts) + "."

    def reasons(self) -> Iterator[str]:
        every = self.payload.get("reasons") or []
        if not every:
            return
        unit = "of impact" if self.by_model else "points"
        lines = [f"**Reasons** (in {unit})"]
        for r in every[: self.most_reasons]:
            where = f" in {_code(r['path'])}" if r.get("path") else ""
            lines.append(f"1. {int(r.get('points') or 0):+d} {r.get('label', '')}{where}: {r.get('detail', '')}")
        rest = len(every) - self.most_reasons
        yield "\n".join([*lines, *([f"\n…and {rest} more."] if rest > 0 else [])])

    def reach(self) -> Iterator[str]:
        if not self.blast.get("analyzed"):
            return
        near, far = self.blast.get("direct_count", 0), self.blast.get("transitive_count", 0)
        if not near + far:
            yield "**Reach**: no file imports what changed."
            return
        lines = [f"**Reach**: {near} files import what changed; {far} more follow within {self.blast.get('max_depth', 0)} steps{', and the trail goes on' if self.blast.get('depth_capped') else ''}."]
        for title, names in (("Importers", self.blast.get("direct")), ("Hubs, of which only some importers are listed", self.blast.get("hubs")), ("In an import cycle", self.blast.get("cycle_files"))):
            if names:
                lines.append(f"- {title}: {_listed(names)}")
        if self.blast.get("files_omitted"):
            lines.append(f"- Not traced: {self.blast['files_omitted']} less risky files")
        yield "\n".join(lines)

    def files(self) -> Iterator[str]:
        risky = [f for f in self.payload.get("files") or [] if f.get("score")]
        if len(risky) > 1:
            body = [f"- {f['score']}: {_code(f['path'])}, {f.get('lines_added', 0)} lines added and {f.get('lines_deleted', 0)} deleted" for f in risky[: self.most_files]]
            rest = len(risky) - self.most_files
            yield _fold("Files by risk", body + ([f"- {rest} others"] if rest > 0 else []))

    def narrative(self) -> Iterator[str]:
        told = self.payload.get("ai_explanation") or {}
        if told.get("available"):
            body = [f"*{told['disclaimer']}*"] if told.get("disclaimer") else []
            body += [f"- {title}: {told[key]}" for key, title in PROSE.items() if told.get(key)]
            yield _fold(f"In words, by {told.get('generated_by') or 'a language model'}", body)

    def footer(self) -> Iterator[str]:
        yield f"<sub>churnlens {self.payload.get('engine_version', '')}, payload {self.payload.get('schema_version', '')}; what counts as risk comes from this repository's own fixes.</sub>"

    def parts(self) -> list[Callable[[], Iterator[str]]]:
        return [self.verdict, self.warnings, self.basis, self.reasons, self.reach, self.files, self.narrative, self.footer]


def comment(payload: dict, threshold: int, most_reasons: int = 5, most_files: int = 5) -> str:
    """Markdown of a payload; ``threshold`` is the gate's."""
    return "\n\n".join([MARKER, *(text for part in Comment(payload, threshold, most_reasons, most_files).parts() for text in part())])


def main(arguments: list[str] | None = None) -> int:
    """Prints the comment of a payload file; with --fail-on-threshold ends with 1 at or above the threshold."""
    import argparse

    parser = argparse.ArgumentParser(prog="churnlens-comment")
    parser.add_argument("payload")
    parser.add_argument("--threshold", type=int, default=65)
    parser.add_argument("--fail-on-threshold", action="store_true")
    options = parser.parse_args(arguments)
    with open(options.payload, encoding="utf-8-sig") as f:
        payload = json.load(f)
    print(comment(payload, options.threshold))
    return int(options.fail_on_threshold and exceeds(payload, options.threshold))
