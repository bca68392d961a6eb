"""Recovering the roles of raw transcripts with a hidden Markov model.

The lines of a transcript are emitted by hidden states: for each role the first line of a turn,
a further line, and the gap after a turn. A line shows a speaker marker (or none, or one of no
known role), how it begins and ends, and its length; blank lines show only that. Start,
transition and emission probabilities are counted on transcripts with known roles, and Viterbi's
best path gives each line its role. Turns are then written in one canonical form.

Rows are parts of transcripts, in order of conversation and part. They are range-partitioned by
that order into segments, so a conversation of any length is spread over tasks. A
conversation that crosses segments is decoded exactly: each of its pieces is reduced to a matrix
of best scores from the state before it to its last state, the driver chains these
matrices (two per segment at most), and each piece is decoded between its known end states.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import cut_lineage

ROLES = ["system", "user", "assistant"]
#: Per role: first line of a turn, further line, gap after the turn.
FIRST, FURTHER, GAP = 0, 1, 2

# The words that mark a speaker.
SPEAKERS = {
    "system": ["system", "context"],
    "user": ["user", "human", "customer", "client", "student", "question", "q", "prompt", "instruction", "me"],
    "assistant": ["assistant", "ai", "bot", "agent", "model", "teacher", "answer", "a", "response", "gpt"],
}
_ROLE_OF = {word: role for role, words in SPEAKERS.items() for word in words}
_MARKER = re.compile(r"\s{0,4}(?:\*\*|#{1,6} ?|\[|<\|?|\()?([A-Za-z]{1,12}) ?(?:\*\*:|:\*\*|:|\]:?|\|?>:?|\):?)[ \t]*").match
_HEADING = re.compile(r"\s{0,4}#{1,6} ?([A-Za-z]{1,12}) ?:?\s*$").match

LENGTH_BINS = 8
SMOOTHING = 0.5
#: Rows of a batch that a decoding task hands on, and the characters after which it does so earlier.
OUT_ROWS, OUT_CHARS = 1_000, 4_000_000


@dataclass(frozen=True)
class Speakers:
    """The roles that turns may have: the three with words of their own, and further ones marked by their name."""

    names: tuple[str, ...] = tuple(ROLES)

    @functools.cached_property
    def role_of(self) -> dict[str, str]:
        return {**_ROLE_OF, **{n.lower(): n for n in self.names}}

    @functools.cached_property
    def marks(self) -> list[str]:
        # Positions of the roles are 1 and up, of a word that marks no role the last.
        return ["none", *self.names, "other"]

    @property
    def blank(self) -> int:
        return len(self.marks)

    @property
    def n_states(self) -> int:
        return 3 * len(self.names)

    @property
    def features(self) -> list[int]:
        """Number of values of each feature of a line that is not blank; blank lines are one value of the first."""
        return [len(self.marks) + 1, 3, 3, LENGTH_BINS]


KNOWN = Speakers()
MARKS = KNOWN.marks
BLANK = KNOWN.blank
N_STATES = KNOWN.n_states


def observe(line: str, speakers: Speakers = KNOWN) -> tuple[int, int, int, int, int]:
    """Marker, beginning, end and length of a line as small numbers, and where its text begins after a marker of a role."""
    text = line.strip()
    if not text:
        return speakers.blank, 0, 0, 0, 0
    mark, at = 0, 0
    found = _HEADING(line) or _MARKER(line)
    if found:
        role = speakers.role_of.get(found.group(1).lower())
        mark, at = (len(speakers.names) + 1, 0) if role is None else (speakers.names.index(role) + 1, found.end())
    begins = 0 if text[0].isupper() else 1 if text[0].islower() else 2
    ends = 0 if text[-1] in ".!?…" else 1 if text[-1] in ":,;" else 2
    return mark, begins, ends, min(LENGTH_BINS - 1, int(math.log2(len(text)))), at


@dataclass
class TranscriptModel:
    """Logarithms of the start, transition and emission probabilities."""

    start: np.ndarray  # state
    step: np.ndarray  # state before, state
    emit: list[np.ndarray]  # per feature: state, value
    speakers: Speakers = KNOWN

    def line_scores(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        """Emission scores, line by state; a blank line has only its first feature."""
        codes = np.array(seen, int).reshape(-1, 5)
        scores = self.emit[0][:, codes[:, 0]].copy()
        for f in (1, 2, 3):
            scores += np.where(codes[:, 0] == self.speakers.blank, 0, self.emit[f][:, codes[:, f]])
        return scores.T


def _logs(counts: np.ndarray) -> np.ndarray:
    smooth = counts + SMOOTHING
    return np.log(smooth / smooth.sum(-1, keepdims=True))


def lines_of(text: str | None) -> list[str]:
    """A null part has no lines; an empty one has one blank line."""
    return [] if text is None else text.split("\n")


def known_states(role: str, seen: list[tuple[int, ...]], speakers: Speakers = KNOWN) -> list[int]:
    """States of the lines of one whole turn: blank lines at its end are the gap."""
    base = 3 * speakers.names.index(role)
    last = max((i for i, s in enumerate(seen) if s[0] != speakers.blank), default=-1)
    return [base + (FIRST if i == 0 else FURTHER if i <= max(last, 0) else GAP) for i in range(len(seen))]


class Counts:
    """Counts of starts, transitions and emissions."""

    def __init__(self, speakers: Speakers = KNOWN):
        n = speakers.n_states
        self.blank = speakers.blank
        self.start = np.zeros(n)
        self.step = np.zeros((n, n))
        self.emit = [np.zeros((n, values)) for values in speakers.features]

    def add(self, before: int | None, states: list[int], seen: list[tuple[int, ...]]) -> None:
        for state, codes in zip(states, seen):
            if before is None:
                self.start[state] += 1
            else:
                self.step[before, state] += 1
            self.emit[0][state, codes[0]] += 1
            if codes[0] != self.blank:
                for f in (1, 2, 3):
                    self.emit[f][state, codes[f]] += 1
            before = state

    def flat(self) -> list[float]:
        return np.concatenate([self.start, self.step.ravel(), *[e.ravel() for e in self.emit]]).tolist()


def _model(flat: np.ndarray, speakers: Speakers = KNOWN) -> TranscriptModel:
    states = speakers.n_states
    start, rest = flat[:states], flat[states:]
    step, rest = rest[: states**2].reshape(states, states), rest[states**2 :]
    emit = []
    for n in speakers.features:
        emit.append(_logs(rest[: states * n].reshape(states, n)))
        rest = rest[states * n :]
    return TranscriptModel(_logs(start), _logs(step), emit, speakers)


def viterbi(scores: np.ndarray, model: TranscriptModel, before: int | None = None, last: int | None = None) -> list[int]:
    """The best path over the lines, after state ``before`` and ending in ``last`` where given."""
    if not len(scores):
        return []
    best = (model.start if before is None else model.step[before]) + scores[0]
    back = np.empty(scores.shape, np.int8 if scores.shape[1] < 128 else np.int32)
    for i in range(1, len(scores)):
        through = best[:, None] + model.step
        back[i] = through.argmax(0)
        best = through.max(0) + scores[i]
    path = [int(best.argmax()) if last is None else last]
    for i in range(len(scores) - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1]


def reduce_piece(scores: np.ndarray, model: TranscriptModel) -> tuple[np.ndarray, np.ndarray]:
    """Best scores of the last state: from a start here, and from each state before the piece."""
    start, through = model.start + scores[0], model.step + scores[0]
    for line in scores[1:]:
        start = (start[:, None] + model.step).max(0) + line
        through = (through[:, :, None] + model.step[None]).max(1) + line
    return start, through


def place_parts(parts: DataFrame, conv_col: str, part_col: str, text_col: str) -> DataFrame:
    """The parts, repeated rows once, with ``segment`` and ``place`` in it: a global order cut into tasks. Written once."""
    rows = parts.select(F.col(conv_col).cast("long").alias("conv"), F.col(part_col).cast("long").alias("part"), F.col(text_col).alias("text"), *[c for c in ("role", "learn") if c in parts.columns])
    extra = [F.min(c).alias(c) for c in ("role", "learn") if c in parts.columns]
    once = rows.groupBy("conv", "part", "text").agg(F.count("*").alias("copies"), *extra)
    # Range bounds are sampled rows that pass the driver, so they hold no texts; equal hashes meet in one task.
    order = [F.col("conv").asc_nulls_first(), F.col("part").asc_nulls_first(), F.xxhash64("text")]
    placed = once.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    placed = placed.select(F.spark_partition_id().alias("segment"), F.monotonically_increasing_id().alias("place"), *once.columns)
    return cut_lineage(placed)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, list[dict]]]:
    """(segment, position in it, whether it is the segment's last, parts) of one conversation after the other; one is held at a time."""
    held, at = [], 0
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {name: batch.column(c)[i].as_py() for c, name in enumerate(names)}
            if held and (held[-1]["segment"], held[-1]["conv"]) != (row["segment"], row["conv"]):
                last = held[-1]["segment"] != row["segment"]
                yield held[-1]["segment"], at, last, held
                held, at = [], 0 if last else at + 1
            held.append(row)
    if held:
        yield held[-1]["segment"], at, True, held


def _in_segments(placed: DataFrame) -> DataFrame:
    return placed.repartition("segment").sortWithinPartitions("segment", "place")


def speakers_of(placed: DataFrame) -> Speakers:
    """The known roles and every further one of a turn to learn from, by name."""
    further = placed.where(F.col("learn") & F.col("role").isNotNull() & ~F.col("role").isin(ROLES)).select("role").distinct()
    # Names of roles, which the states of the model are squared numbers of.
    return Speakers((*ROLES, *sorted(r["role"] for r in further.collect())))


def fit_transcripts(placed: DataFrame) -> TranscriptModel:
    """Count on the parts whose ``learn`` is true and whose ``role`` is not null; each is one turn.

    Any other part is passed over. Without any part to learn from all states are alike.
    """
    speakers = speakers_of(placed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first, first_conv = Counts(speakers), None, None
        for segment, at, is_last, conv in _conversations(batches):
            if at == 0:
                counts, first, first_conv = Counts(speakers), None, conv[0]["conv"]
            before = None
            for row in conv:
                seen = [observe(x, speakers) for x in lines_of(row["text"])]
                if not row["learn"] or row["role"] is None or not seen:
                    continue
                states = known_states(row["role"], seen, speakers)
                if before is None and at == 0 and first is None:
                    # It may go on from the segment before: the driver counts its first line.
                    first = states[0]
                    counts.add(None, states, seen)
                    counts.start[states[0]] -= 1
                else:
                    counts.add(before, states, seen)
                before = states[-1]
            if is_last:
                yield pa.RecordBatch.from_pydict(
                    {"segment": [segment], "counts": [counts.flat()], "first_conv": [first_conv], "last_conv": [conv[0]["conv"]], "first": [first], "last": [before]},
                    pa.schema([("segment", pa.int64()), ("counts", pa.list_(pa.float64())), ("first_conv", pa.int64()), ("last_conv", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]),
                )

    schema = "segment long, counts array<double>, first_conv long, last_conv long, first long, last long"
    # One row of a few hundred numbers per segment.
    rows = sorted(_in_segments(placed).mapInArrow(count, schema).collect(), key=lambda r: r["segment"])
    total, states = np.zeros(len(Counts(speakers).flat())), speakers.n_states
    before = None
    for r in rows:
        total += np.array(r["counts"])
        if r["first"] is not None:
            if before is not None and before["last"] is not None and before["last_conv"] == r["first_conv"]:
                total[states + before["last"] * states + r["first"]] += 1
            else:
                total[r["first"]] += 1
        before = r
    return _model(total, speakers)


def _border_states(placed: DataFrame, model: TranscriptModel) -> dict[int, dict]:
    """For each segment: the state before its first conversation, the last state of either end, and whether it goes on."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("segment", pa.int64()), ("at", pa.int64()), ("conv", pa.int64()), ("start", pa.list_(pa.float64())), ("through", pa.list_(pa.float64()))])
        for segment, at, is_last, conv in _conversations(batches):
            if at and not is_last:
                continue
            seen = [observe(x, model.speakers) for row in conv for x in lines_of(row["text"])]
            start, through = reduce_piece(model.line_scores(seen), model) if seen else (None, None)
            row = [[segment], [at], [conv[0]["conv"]], [None if start is None else start.tolist()], [None if through is None else through.ravel().tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

    schema = "segment long, at long, conv long, start array<double>, through array<double>"
    # Two rows per segment, of about the number of states squared.
    states = model.speakers.n_states
    pieces = sorted(_in_segments(placed).mapInArrow(reduce, schema).collect(), key=lambda r: (r["segment"], r["at"]))
    chains: list[list] = []
    for p in pieces:
        # A conversation goes on from the last of one segment to the first of the next.
        if chains and chains[-1][-1]["conv"] == p["conv"] and chains[-1][-1]["segment"] != p["segment"] and p["at"] == 0:
            chains[-1].append(p)
        else:
            chains.append([p])
    known: dict[int, dict] = {}
    for chain in chains:
        forward, so_far = [], None
        for p in chain:
            if p["start"] is not None:
                if so_far is None:
                    so_far = np.array(p["start"])
                else:
                    so_far = (so_far[:, None] + np.array(p["through"]).reshape(states, states)).max(0)
            forward.append(so_far)
        state = None if so_far is None else int(so_far.argmax())
        for i in range(len(chain) - 1, -1, -1):
            p, last = chain[i], state
            earlier = forward[i - 1] if i else None
            if earlier is None:
                before = None
            elif p["start"] is None:
                before = last
            else:
                before = int((earlier + np.array(p["through"]).reshape(states, states)[:, last]).argmax())
            known.setdefault(p["segment"], {})[p["at"]] = (before, last, i < len(chain) - 1)
            state = before
    return known


def render(parts: list[list[str]], seen: list[tuple[int, ...]], states: list[int], before: int | None, goes_on: bool, names: tuple[str, ...] = KNOWN.names) -> tuple[list[str], list[str | None], list[int]]:
    """Per part: its canonical text, the role of its first line that is not a gap, and how many turns begin in it.

    Texts of consecutive parts, joined, are the canonical transcript.
    """
    texts, roles, turns = [], [], []
    at, open_role = 0, None if before is None else names[before // 3]
    for p, lines in enumerate(parts):
        out, first_role, n = [], None, 0
        for line in lines:
            role, kind = names[states[at] // 3], states[at] % 3
            if kind != GAP:
                if kind == FIRST or role != open_role:
                    if open_role is not None:
                        out.append("<|end|>\n")
                    out.append(f"<|{role}|>\n")
                    open_role = role
                    n += 1
                    line = line[seen[at][4] :]
                    if line or not seen[at][4]:
                        out.append(line + "\n")
                else:
                    out.append(line + "\n")
                first_role = first_role or role
            at += 1
        if p == len(parts) - 1 and not goes_on and open_role is not None:
            out.append("<|end|>\n")
        texts.append("".join(out))
        roles.append(first_role)
        turns.append(n)
    return texts, roles, turns


def parse_placed(placed: DataFrame, model: TranscriptModel) -> DataFrame:
    borders = _border_states(placed, model)  # a few numbers per segment

    schema = pa.schema([
        ("conv", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("parsed_role", pa.string()), ("n_lines", pa.int64()), ("n_turns", pa.int64()), ("rendered", pa.string()), ("copies", pa.int64()),
    ])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speakers, out, chars = model.speakers, [], 0
        for segment, at, _, conv in _conversations(batches):
            # Only the first and the last of a segment have borders.
            before, last, goes_on = borders[segment].get(at, (None, None, False))
            parts = [lines_of(row["text"]) for row in conv]
            seen = [observe(x, speakers) for lines in parts for x in lines]
            states = viterbi(model.line_scores(seen), model, before, last) if seen else []
            texts, roles, turns = render(parts, seen, states, before, goes_on, speakers.names)
            for row, lines, text, role, n in zip(conv, parts, texts, roles, turns):
                out.append((row["conv"], row["part"], row["text"], role, len(lines), n, text, row["copies"]))
                chars += len(text)
                if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return _in_segments(placed).mapInArrow(decode, "conv long, part long, text string, parsed_role string, n_lines long, n_turns long, rendered string, copies long")


def parse_transcripts(parts: DataFrame, conv_col: str = "conv_id", part_col: str = "turn", text_col: str = "text", role_col: str = "role", learn_col: str = "learn") -> DataFrame:
    """One row per distinct part: conv, part, text, parsed_role, n_lines, n_turns, rendered, copies.

    ``parts`` has raw transcript text in order of ``part_col``; where ``learn_col`` is true, a part is one
    whole turn of ``role_col`` and the model learns from it. ``parsed_role`` is the role of the first line that
    belongs to a turn (null if there is none); ``rendered`` texts of a conversation, joined in order, are its
    canonical transcript. A learned role beyond system, user and assistant is a role of its own, marked by its
    name; a null role is not learned from. Rows equal in conversation, part and text are one part (``copies`` counts them);
    parts of equal number follow by a hash of the text. Null conversations are one conversation, null parts
    come first, a null text has no lines, an empty one a blank line. An empty table gives no rows.
    """
    given = parts.select(F.col(conv_col).alias("conv_id"), F.col(part_col).alias("turn"), F.col(text_col).alias("text"), F.col(role_col).alias("role"), F.col(learn_col).alias("learn"))
    placed = place_parts(given, "conv_id", "turn", "text")
    return parse_placed(placed, fit_transcripts(placed))


def raw_transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Transcripts as people paste them, made from known turns: five styles of markers, some left out, some blank lines.

    Roles beyond the three are marked by their name. Style and gaps depend on hashes of the ids only. ``learn`` is true for four conversations in five.
    """
    # Markers of a style for system, user, assistant.
    styles = [
        ("System: ", "User: ", "Assistant: "),
        ("System: ", "Human: ", "AI: "),
        ("### System\n", "### Instruction\n", "### Response\n"),
        ("Context: ", "Q: ", "A: "),
        ("[system] ", "[user] ", "[bot] "),
    ]

    def drawn(*parts, n: int):
        return F.crc32(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if p in turns.columns else F.lit(p) for p in parts]).cast("binary")) % n

    style = drawn(conv_col, "style", n=len(styles))
    marker = F.lit(None).cast("string")
    for k, words in enumerate(styles):
        for role, word in zip(ROLES, words):
            marker = F.when((style == k) & (F.col(role_col) == role), F.lit(word)).otherwise(marker)
    # One marker in six is missing; a turn without one is set off by blank lines more often.
    bare = drawn(conv_col, turn_col, "bare", n=6) == 0
    gap = drawn(conv_col, turn_col, "gap", n=4) != 0
    raw = F.concat(F.when(bare, F.lit("")).otherwise(F.coalesce(marker, F.concat(F.col(role_col), F.lit(": ")), F.lit(""))), F.col(text_col), F.when(gap, F.lit("\n")).otherwise(F.lit("")))
    return turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), raw.alias("text"), (drawn(conv_col, n=5) != 0).alias("learn")
    )


def transcript_table(turns: DataFrame) -> DataFrame:
    """Raw transcripts of all turns, parsed: conv_id, turn, parsed_role, n_lines, n_turns, rendered."""
    parsed = parse_transcripts(raw_transcripts(turns))
    return parsed.select(F.col("conv").alias("conv_id"), F.col("part").alias("turn"), "parsed_role", "n_lines", "n_turns", "rendered", "copies")
