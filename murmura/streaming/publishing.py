"""What a client is sent as a transcript grows: the last paragraph, a refresh of all of them, or nothing.

The stream brings chunks (session_id, recording, chunk_id, start, end, speaker, text), each new or a new version of an old one.  A session's state
holds its chunks, what its client has seen of each paragraph (a digest), how many messages it was sent and how many speakers it knows of.  After each
micro-batch its paragraphs are formed anew and compared with what was sent:

- nothing differs: no message;
- one paragraph differs and it is the last one: a ``transcript`` message with that paragraph;
- anything else: a ``refresh``, a row for each paragraph (one row without any, if none is left), all with one number.

If the number of speakers changed, a ``speakers`` message follows.  Messages are numbered by session from 1 on, across restarts.

``messages`` gives the rows as a stream, ``versions.each_batch`` is the sink that writes each micro-batch once, and
``records.client_view`` what a client shows in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from murmura.session import ship

SCHEMA = "session_id long, seq long, type string, recording long, paragraph_id long, start double, end double, speaker int, text string, speakers int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
CHUNK = ["recording", "chunk_id", "start", "end", "speaker", "text"]


def paragraphs(chunks: list[tuple]) -> list[tuple]:
    """(recording, paragraph_id, start, end, speaker, text) of chunks (CHUNK): consecutive ones of one speaker (0 if null) and recording; blank ones don't count."""
    out: list[list] = []
    for recording, chunk_id, start, end, speaker, text in sorted(chunks, key=lambda c: (c[2], c[1])):
        if not text or not text.strip():
            continue
        if out and (out[-1][0], out[-1][4]) == (recording, speaker):
            last = out[-1]
            last[3], last[5] = end, f"{last[5]} {text}"
        else:
            out.append([recording, chunk_id, start, end, speaker, text])
    return [tuple(p) for p in out]


def due(shown: list[tuple], sent: dict[int, str]) -> tuple[str, dict[int, str]]:
    """none, transcript or refresh for the paragraphs to be shown, and the digests that a client has then."""
    now = {p[1]: hashlib.sha256(repr(p).encode()).hexdigest() for p in shown}
    changed = [k for k in now.keys() | sent.keys() if now.get(k) != sent.get(k)]
    if not changed:
        return "none", now
    return "transcript" if shown and changed == [shown[-1][1]] else "refresh", now


class Publisher(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk_id long", "recording long, start double, end double, speaker int, text string")
        self.sent = handle.getMapState("sent", "paragraph_id long", "digest string")
        self.counts = handle.getValueState("counts", "messages long, speakers int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            # By place: a computed column reaches a stateful processor without its name.
            for recording, chunk_id, start, end, speaker, text in part.iloc[:, 1:].itertuples(index=False):
                value = (None if pd.isna(recording) else int(recording), float(start), float(end), 0 if pd.isna(speaker) else int(speaker), text)
                self.chunks.updateValue((int(chunk_id),), value)
        held = [(v[0], k[0], *v[1:]) for k, v in self.chunks.iterator()]
        shown = paragraphs(held)
        before = {k[0]: v[0] for k, v in self.sent.iterator()}
        mode, now = due(shown, before)
        number, known = self.counts.get() if self.counts.exists() else (0, 0)
        out = []
        if mode != "none":
            number += 1
            for p in shown[-1:] if mode == "transcript" else shown or [(None,) * 6]:
                out.append((key[0], number, mode, *p, None))
        speakers = len({p[4] for p in shown})
        if speakers and speakers != known:
            number, known = number + 1, speakers
            out.append((key[0], number, "speakers", *(None,) * 6, speakers))
        for k in before.keys() - now.keys():
            self.sent.removeKey((k,))
        for k, digest in now.items():
            if before.get(k) != digest:
                self.sent.updateValue((k,), (digest,))
        self.counts.update((number, known))
        yield pd.DataFrame(out, columns=COLUMNS).astype({"recording": "Int64", "paragraph_id": "Int64", "speaker": "Int32", "speakers": "Int32"})

    def close(self) -> None:
        pass


def messages(chunks: DataFrame) -> DataFrame:
    """The messages of a stream of chunks; needs the RocksDB state store."""
    ship(chunks.sparkSession)
    rows = chunks.selectExpr("session_id", "CAST(recording AS LONG) AS recording", "CAST(chunk_id AS LONG) AS chunk_id", "CAST(start AS DOUBLE) AS start", "CAST(end AS DOUBLE) AS end", "CAST(speaker AS INT) AS speaker", "text")
    return rows.groupBy("session_id").transformWithStateInPandas(Publisher(), SCHEMA, "Append", "None")
