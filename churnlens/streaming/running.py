"""Running counts over a stream of touches: the streaming twin of the batch window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.storage import ship

OUTPUT = "path string, sha string, seq long, prior_commits long, prior_fixes long"
STATE = "commits long, fixes long, open_seq long, open_commits long, open_fixes long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts before the present commit, and those of the commit still open: rows of one commit don't see each other."""
    commits, fixes, at, own, own_fixes = state.get if state.exists else (0, 0, None, 0, 0)
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    out = []
    for sha, seq, bugfix in rows[["sha", "seq", "is_bugfix"]].itertuples(index=False):
        if seq != at:
            commits, fixes, at, own, own_fixes = commits + own, fixes + own_fixes, int(seq), 0, 0
        out.append((key[0], sha, int(seq), commits, fixes))
        own, own_fixes = own + 1, own_fixes + int(bool(bugfix))
    state.update((commits, fixes, at, own, own_fixes))
    yield pd.DataFrame(out, columns=["path", "sha", "seq", "prior_commits", "prior_fixes"])


def running_counts(touches: DataFrame) -> DataFrame:
    """Streaming touches (path, sha, seq, is_bugfix), arriving in log order, with the counts before each."""
    ship(touches.sparkSession)
    return touches.select("path", "sha", "seq", "is_bugfix").groupBy("path").applyInPandasWithState(_advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
