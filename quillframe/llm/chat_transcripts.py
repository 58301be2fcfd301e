"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript's non-blank lines are the observations; the hidden states are role and position (first line of a turn, or a
later one). A line is seen as its speaker marker (none, system, user, assistant, first or other named speaker), its length,
whether it ends in a question mark and whether a blank line precedes it; these are taken as independent given the state.
Start, transition and emission probabilities are smoothed counts over labelled conversations; the most probable
path by Viterbi gives the turns, whose markers are removed and which are rendered in one form.

Only training is bounded: at most SAMPLE_CONVERSATIONS conversations, chosen by hash of conv_id.

Defined results: null, empty and blank transcripts have no turns and render to an empty text; null roles and texts of
training turns count as user turns and empty texts; turns sort by number, null first, and ties by role and text; repeated
rows are each parsed; a "<|" inside a text is broken up, so no text can forge a turn; extra columns are ignored; an
empty table gives an empty result, and without training turns all states are equally probable. A very long transcript
is one sequence, whose path takes 6 bytes of states and one step a line; of equally probable paths the first is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
STATES = [(role, first) for role in ROLES for first in (True, False)]
MARKERS = {
    "system": "system|instructions?|context|setup",
    "user": "user|human|customer|client|question|you|me|q",
    "assistant": "assistant|ai|bot|agent|support|answer|model|a",
}
_LEAD, _END = r"^\s*(?:#{1,6}\s*|>\s*|[-*]\s+)?[*_\[<(|]{0,3}\s*", r"\s*(?:[\])>|]{1,2}|[*_]{0,2}\s*[:：][*_]{0,2}|\s-\s)\s*"
KNOWN = re.compile(_LEAD + "(?:" + "|".join(f"(?P<{k}>{v})" for k, v in MARKERS.items()) + ")" + _END, re.I)
NAMED = re.compile(r"^\s*([A-Z][\w.-]{0,19}(?: [A-Z][\w.-]{0,19})?):(?:\s+|$)")
KINDS = ("none", *ROLES, "speaker", "other speaker")
SIZES = ((len(KINDS),), (5,), (2,), (2,))
SAMPLE_CONVERSATIONS = 2000
#: Share of the start that any role may have, since exports also begin in the middle, and of lines that are of any length and form.
ANY_START, ANY_LINE = 0.1, 0.1
STYLES = 7


def lines_of(transcript: str) -> list[tuple[tuple[int, int, int, int], str, int]]:
    """(features, text without its marker, blank lines before it) of each non-blank line."""
    out, blank, speakers = [], 0, {}
    for line in transcript.split("\n"):
        if not line.strip():
            blank += 1
            continue
        kind, text = 0, line
        if m := KNOWN.match(line):
            kind, text = KINDS.index(m.lastgroup), line[m.end() :]
        elif m := NAMED.match(line):
            kind, text = 4 + min(1, speakers.setdefault(m[1], len(speakers))), line[m.end() :]
        n = len(text)
        out.append(((kind, 0 if not n else 1 + (n > 60) + (n > 200) + (n > 600), int(text.rstrip().endswith("?")), int(blank > 0)), text, blank))
        blank = 0
    return out


@dataclass
class Model:
    """Log probabilities: start by state, step from state to state, emit by feature, state and value."""

    start: np.ndarray = field(default_factory=lambda: np.zeros(len(STATES)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((len(STATES), len(STATES))))
    emit: list[np.ndarray] = field(default_factory=lambda: [np.zeros((len(STATES), *n)) for n in SIZES])

    def path(self, features: list[tuple[int, int, int, int]]) -> list[int]:
        """The most probable states; of equally probable ones the first."""
        if not features:
            return []
        seen = np.array(features)
        score = sum(e[:, seen[:, k]] for k, e in enumerate(self.emit)).T
        best, back = self.start + score[0], []
        for row in score[1:]:
            move = best[:, None] + self.step
            back.append(move.argmax(0))
            best = move.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def turns(self, transcript: str | None) -> list[tuple[str, str]]:
        """(role, text) of each turn."""
        lines = lines_of(transcript or "")
        out: list[tuple[str, list[str]]] = []
        for state, (_, text, blank) in zip(self.path([x[0] for x in lines]), lines):
            role, first = STATES[state]
            if first or not out or out[-1][0] != role:
                out.append((role, [text]))
            else:
                out[-1][1].extend([""] * blank + [text])
        return [(role, "\n".join(text).strip()) for role, text in out]


def fit(labelled: list[tuple[list[tuple[int, int, int, int]], list[int]]], smooth: float = 0.5) -> Model:
    """From (features, states) of each transcript, the smoothed model."""
    n = len(STATES)
    start, step, emit = np.full(n, smooth), np.full((n, n), smooth), [np.full((n, *k), smooth) for k in SIZES]
    for features, states in labelled:
        for i, (f, s) in enumerate(zip(features, states)):
            if i:
                step[states[i - 1], s] += 1
            else:
                start[s] += 1
            for k, value in enumerate(f):
                emit[k][s, value] += 1
    for s, (_, first) in enumerate(STATES):  # a later line continues its own role
        if not first:
            step[[k for k in range(n) if STATES[k][0] != STATES[s][0]], s] = 1e-9
            start[s] = 1e-9
    first = np.array([1.0 if f else 1e-9 for _, f in STATES])
    start = (1 - ANY_START) * start / start.sum() + ANY_START * first / first.sum()
    emit = [e / e.sum(1, keepdims=True) for e in emit]
    emit = emit[:1] + [(1 - ANY_LINE) * e + ANY_LINE / e.shape[1] for e in emit[1:]]
    return Model(np.log(start), np.log(step / step.sum(1, keepdims=True)), [np.log(e) for e in emit])


def transcript_of(turns: list[tuple[str | None, str | None]], style: int) -> tuple[str, list[tuple[str, str]]]:
    """A conversation written out in one of the styles that exports use, and the (role, text) of each turn in it."""
    names = {
        0: ("System: ", "User: ", "Assistant: "), 1: ("### System:\n", "### Human:\n", "### Assistant:\n"), 2: ("Context: ", "Q: ", "A: "), 3: ("[SYSTEM] ", "[USER] ", "[BOT] "),
        4: ("**System**: ", "**User**: ", "**Assistant**: "), 5: ("System: ", "User: ", ""), 6: ("Instructions: ", "Anna: ", "Tom: "),
    }[style]
    gap, out, truth = ("\n\n" if style in (1, 5) else "\n"), [], []
    for role, text in turns:
        role = role if role in ROLES else "user"
        out.append(names[ROLES.index(role)] + (text or "").strip())
        truth.append((role, (text or "").strip()))
    return gap.join(out), truth


def labelled_lines(turns: list[tuple[str | None, str | None]], style: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Features and true states of a conversation written out in a style."""
    transcript, truth = transcript_of(turns, style)
    lines, states = lines_of(transcript), []
    for k, (role, _) in enumerate(truth):
        size = len(lines_of(transcript_of(turns[k : k + 1], style)[0]))
        states += [STATES.index((role, i == 0)) for i in range(size)]
    return [x[0] for x in lines], states


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns of each conversation in order."""
    turn = F.struct("turn", "role", "text")
    return common.need(rows, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def style_of(conv_id: int | None) -> int:
    return (conv_id or 0) * 2654435761 % (1 << 32) * STYLES >> 32


def train(rows: DataFrame, conversations: int = SAMPLE_CONVERSATIONS, styles: tuple[int, ...] = tuple(range(STYLES))) -> Model:
    """The model of a bounded sample, each conversation of it written out in every one of the styles."""
    some = rows.filter("conv_id is not null").select("conv_id").distinct().orderBy(F.md5(F.col("conv_id").cast("string")), "conv_id").limit(conversations)
    chosen = conversations_of(rows.join(F.broadcast(some), "conv_id", "left_semi")).orderBy("conv_id").collect()  # bounded
    return fit([labelled_lines([(t.role, t.text) for t in c.turns], k) for c in chosen for k in styles])


def write_out(rows: DataFrame) -> DataFrame:
    """(conv_id, transcript): every conversation as an export would hold it, in a style that its id decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [transcript_of([(t["role"], t["text"]) for t in turns], style_of(c))[0] for c, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string())], ["conv_id", "transcript"])

    return conversations_of(rows).mapInArrow(run, "conv_id long, transcript string")


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>\n" for role, text in turns)


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """(conv_id, n_turns, roles, rendered) of each row (conv_id, transcript)."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.turns(t) for t in batch.column("transcript").to_pylist()]
            columns = [pa.array([len(t) for t in found], pa.int32()), pa.array([",".join(r for r, _ in t) for t in found], pa.string()), pa.array([render(t) for t in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", "n_turns", "roles", "rendered"])

    return common.need(transcripts, "conv_id", "transcript").mapInArrow(run, "conv_id long, n_turns int, roles string, rendered string")


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, written out as a raw transcript and recovered from it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return parse(write_out(rows), train(rows))
