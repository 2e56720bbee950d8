"""Decisions as a stream: the latest choice of each citation, kept as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "file string, seq long, citation_id string, choice long"
_STATE = "cleared long, seqs map<string, long>, choices map<string, long>"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    cleared, seqs, choices = state.get if state.exists else (-1, {}, {})
    seqs, choices, out = dict(seqs), dict(choices), []
    for e in pd.concat(list(batches)).sort_values("seq").itertuples():
        if e.action == "clear" and e.seq > cleared:
            cleared = int(e.seq)
            for c in [c for c, s in seqs.items() if s < cleared]:
                out.append((key[0], cleared, c, None))
                del seqs[c], choices[c]
        elif e.action == "resolve" and e.seq > max(cleared, seqs.get(e.citation_id, -1)):
            seqs[e.citation_id], choices[e.citation_id] = int(e.seq), int(e.choice)
            out.append((key[0], int(e.seq), e.citation_id, int(e.choice)))
    state.update((cleared, seqs, choices))
    yield pd.DataFrame(out, columns=["file", "seq", "citation_id", "choice"]).astype({"choice": "Int64", "seq": "int64"})


def resolution_changes(events: DataFrame) -> DataFrame:
    """Changes (file, seq, citation_id, choice; a null choice undoes) from a stream of events (file, seq, action, citation_id, choice).

    Events of a batch are taken in the order of seq; later batches may bring
    earlier events, which do not undo newer ones.
    """
    return events.groupBy("file").applyInPandasWithState(_fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
