"""Chat transcripts to canonical turns by a hidden Markov model.

A transcript is plain text in which speakers are marked somehow, or not at all. Each line that is
not blank is one observation: the kind of speaker marker it begins with, whether a blank line is
before it, its length, its ending. The states are a role's first line and its further lines, for
system, user and assistant. Start, transition and emission counts come from transcripts with known
roles, as grouped sums over all of them (a table of a few hundred cells); Viterbi's algorithm then
recovers the roles, and runs of lines are rendered as canonical turns.

A conversation of any length is parsed whole: it is cut into pieces of PART turns only for the work.
What a piece needs from those before it (speakers' names so far, blank line or not) is carried over
by a scan of small summaries. Viterbi's recursion is a product of matrices in the (max, +) algebra, so
each piece first gives its matrix; a scan of the matrices, six by six numbers for PART turns, finds
the states in which the best path enters and leaves each piece; and the piece's own best path between
these is part of the best path of the whole.

Defined cases: null or blank text has no turns and renders as an empty string; a marker without
words makes an empty turn; text that looks like a canonical tag is escaped; white space at the end of
lines goes; of turns with one number role and text decide the order; null turn numbers come first;
repeated rows are turns like others; null conv_id can't be named and goes; very long texts are parsed
whole; clashing columns of the input are replaced; without training rows the model is uniform; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

ROLES = ("system", "user", "assistant")
STATES = tuple((r, k) for r in ROLES for k in ("first", "further"))
#: Words that name a role before a colon or on a line of their own (fixed values).
WORDS = {
    "system": "system sys instruction instructions context".split(),
    "user": "user human question q customer client prompt me".split(),
    "assistant": "assistant bot ai answer a agent model support".split(),
}
_ROLE_OF = {w: r for r, ws in WORDS.items() for w in ws}
_MARKER = re.compile(r"\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?(?P<who>[^\W\d_]{1,20})(?:\*\*|\]|\|?>)?\s*(?P<end>:(?:\*\*)?|(?<=[\]>*])|$)\s*")
SMOOTH = 0.5
#: Turns of one piece.
PART = 500


def markers(lines: list[str], names: tuple[str, ...] = ()) -> tuple[list[tuple[str, int]], list[str]]:
    """Kind of each line's speaker marker, and where the text after it starts; and the first names so
    far. Names that are no role's words are numbered in the order in which they first appear, the
    third and all later ones alike."""
    seen, out = list(names), []
    for line in lines:
        m = _MARKER.match(line)
        bare = m and not m["end"] and not re.match(r"\s*(#|\*\*|\[|<)", line)
        if not m or bare:
            out.append(("none", 0))
            continue
        who = m["who"].lower()
        if who in _ROLE_OF:
            out.append((_ROLE_OF[who], m.end()))
        else:
            if who not in seen and len(seen) < 2:
                seen.append(who)
            out.append((f"name{seen.index(who) + 1 if who in seen else 3}", m.end()))
    return out, seen


def _lines(text: str | None, gap: str) -> tuple[list[str], list[str], str]:
    """Lines that are not blank, what is before each (begin, none or a blank line), and the gap at
    the end."""
    lines, gaps = [], []
    for line in (text or "").split("\n"):
        if line.strip():
            lines.append(line)
            gaps.append(gap)
            gap = "none"
        elif gap == "none":
            gap = "blank"
    return lines, gaps, gap


def observe(text: str | None, names: tuple[str, ...] = (), gap: str = "begin") -> tuple[list[str], list[int], list[dict[str, str]]]:
    """Lines that are not blank, where their text starts, and their features. names and gap: of the
    transcript before this text."""
    lines, gaps, _ = _lines(text, gap)
    feats, starts = [], []
    for line, gap, (kind, start) in zip(lines, gaps, markers(lines, names)[0], strict=True):
        n, last = len(line), line.rstrip()[-1]
        feats.append({"marker": kind, "gap": gap, "size": str(sum(n > x for x in (1, 20, 80, 200, 600))), "end": last if last in "?.:!" else "other", "first": str(gap == "begin")})
        starts.append(start)
    return lines, starts, feats


class Model:
    """Log-probabilities from counts keyed (kind, state or None, value)."""

    def __init__(self, counts: dict[tuple[str, int, str], float]):
        n = len(STATES)
        self.start = np.full(n, SMOOTH)
        self.move = np.full((n, n), SMOOTH)
        self.emit: dict[str, dict[str, np.ndarray]] = {}
        for r in range(len(ROLES)):  # nothing begins with a further line, or goes on with another role's
            self.start[2 * r + 1] = 0
            self.move[[s for s in range(n) if s // 2 != r], 2 * r + 1] = 0
        for (kind, state, value), k in counts.items():
            if kind == "start":
                self.start[state] += k
            elif kind == "move":
                self.move[state, int(value)] += k
            else:
                self.emit.setdefault(kind, {}).setdefault(value, np.full(n, SMOOTH))[state] += k
        with np.errstate(divide="ignore"):
            self.start, self.move = np.log(self.start / self.start.sum()), np.log(self.move / self.move.sum(axis=1, keepdims=True))
        for values in self.emit.values():
            total = sum(values.values()) + SMOOTH
            self.emit_unknown = -np.log(total)
            for v in values:
                values[v] = np.log(values[v] / total)

    def emission(self, feats: dict[str, str]) -> np.ndarray:
        out = np.zeros(len(STATES))
        for kind, value in feats.items():
            known = self.emit.get(kind, {}).get(value)
            if known is not None:
                out = out + known
        return out

    def viterbi(self, feats: list[dict[str, str]], enter: int | None = None, leave: int | None = None) -> tuple[list[int], float]:
        """The likeliest states of the lines and their log-probability; after state `enter` and with
        state `leave` at the end, if given."""
        if not feats:
            return [], 0.0
        best, back = (self.start if enter is None else self.move[enter]) + self.emission(feats[0]), []
        for f in feats[1:]:
            step = best[:, None] + self.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + self.emission(f)
        path = [int(best.argmax()) if leave is None else leave]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1], float(best[path[0]])

    def matrix(self, feats: list[dict[str, str]], first: bool) -> np.ndarray:
        """Log-probability of the best path through the lines from each state before them (from the
        beginning, if first) to each state of the last."""
        n = len(STATES)
        if not feats:
            return np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
        out = (np.tile(self.start, (n, 1)) if first else self.move) + self.emission(feats[0])
        for f in feats[1:]:
            out = (out[:, :, None] + self.move).max(axis=1) + self.emission(f)
        return out


def _turns(lines: list[str], starts: list[int], feats: list[dict[str, str]], path: list[int]) -> list[tuple[str, str]]:
    """(role, text) of each turn; the first may go on with the turn before."""
    out: list[tuple[str, list[str]]] = []
    for k, (line, start, state, f) in enumerate(zip(lines, starts, path, feats, strict=True)):
        role, kind = STATES[state]
        if kind == "first" or not k:
            out.append((role, []))
        if kind == "first":
            line = (line[start:] if f["marker"] != "none" else line).lstrip()
        out[-1][1].append(line.rstrip())
    return [(r, "\n".join(x)) for r, x in out]


def turns(text: str | None, model: Model) -> tuple[list[tuple[str, str]], list[str]]:
    """(role, text) of each turn, and each line's role."""
    lines, starts, feats = observe(text)
    path, _ = model.viterbi(feats)
    return _turns(lines, starts, feats, path), [STATES[s][0] for s in path]


def _escaped(text: str) -> str:
    return text.replace("<|", "<\\|")


def render(found: list[tuple[str, str]]) -> str:
    """Canonical turns."""
    return "".join(f"<|{role}|>\n{_escaped(text)}\n<|end|>\n" for role, text in found)


def parse_canonical(text: str) -> list[tuple[str, str]]:
    return [(r, t.replace("<\\|", "<|")) for r, t in re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", text, re.DOTALL)]


def _tally(lines: list[tuple[str, str]], text: str, counts: Counter, names: tuple[str, ...] = (), gap: str = "begin", before: int | None = None) -> None:
    """Count the states of a transcript of which each line's (role, first or further) is known."""
    _, _, feats = observe(text, names, gap)
    for state, f in zip(lines, feats, strict=True):
        s = STATES.index(state)
        if before is None:
            counts["start", s, ""] += 1
        else:
            counts["move", before, str(s)] += 1
        for kind, value in f.items():
            counts[kind, s, value] += 1
        before = s


def train(transcripts: DataFrame) -> Model:
    """transcripts: text and states (array of `role first` or `role further`, one for each line that
    is not blank); for pieces of longer ones also names, gap and before (the state before, or null)."""
    pieces = "before" in transcripts.columns
    rows = transcripts.select("text", "states", *(("names", "gap", "before") if pieces else ()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: Counter = Counter()
            for r in pdf.itertuples():
                more = (tuple(r.names), r.gap, None if pd.isna(r.before) else int(r.before)) if pieces else ()
                _tally([tuple(s.split(" ")) for s in r.states], r.text, counts, *more)
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "state", "value", "n"])

    cells = rows.mapInPandas(c.freed(run), "kind string, state int, value string, n long").groupBy("kind", "state", "value").agg(F.sum("n").alias("n"))
    return Model({(r.kind, r.state, r.value): float(r.n) for r in cells.collect()})


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """transcripts with n_lines, line_roles, turns (array of role and text) and rendered."""
    new = ("n_lines", "line_roles", "turns", "rendered")
    rows = transcripts.drop(*new)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [turns(t, model) for t in pdf["text"]]
            yield pdf.assign(n_lines=[len(r) for _, r in got], line_roles=[r for _, r in got], turns=[[{"role": r, "text": t} for r, t in x] for x, _ in got], rendered=[render(x) for x, _ in got])

    return rows.mapInPandas(c.freed(run), f"{schema}, n_lines long, line_roles array<string>, turns array<struct<role:string,text:string>>, rendered string")


#: Ways in which raw transcripts mark their speakers, dealt by conversation.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
    {"system": "### System\n", "user": "### Human\n", "assistant": "### Assistant\n"},
    {"system": "[Instructions] ", "user": "[Customer] ", "assistant": "[Support] "},
    {"system": "", "user": "Robin: ", "assistant": "Kim: "},
    {"system": "", "user": "", "assistant": ""},
)


def style_of(key: int) -> int:
    """A hash that has nothing to do with the one that sets conversations apart for tests."""
    return xxhash.xxh3_64_intdigest(f"style {key}") % len(STYLES)


def raw_transcript(key: int, found: list[tuple[str | None, str | None]]) -> tuple[str, list[str]]:
    """A plain transcript of (role, text) turns as people paste them, and its lines' states: the
    style goes by the key, one marker in ten is missing, and turns stand apart by blank lines where
    the style has no markers."""
    style = STYLES[style_of(key)]
    parts, states = [], []
    for role, text in found:
        role = role if role in ROLES else "user"
        mark = "" if xxhash.xxh3_64_intdigest(f"{key} {role} {text}".encode("utf-8", "surrogatepass")) % 10 == 0 else style[role]
        body = mark + (text or "")
        n = sum(bool(line.strip()) for line in body.split("\n"))
        parts.append(body)
        states += [f"{role} {'further' if i else 'first'}" for i in range(n)]
    return ("\n\n" if _apart(key) else "\n").join(parts), states


def _apart(key: int) -> bool:
    """Whether blank lines stand between the turns."""
    return not STYLES[style_of(key)]["user"] or key % 2 == 1


def pieces(conversations: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, piece, text, states, names (of the first speakers without a role's name), gap: each
    conversation (turns in order; null texts are empty, roles other than ROLES count as user) as a
    raw transcript, in pieces of at most `part` turns. A conversation's pieces follow each other in
    the order of `piece`, at line ends; with over `part` turns it may lie over several tasks."""
    keys = ["conv_id", "turn", "role", "text", "_row"]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = c.table(rows.groupBy("conv_id").count().where(F.col("count") > part).select("conv_id", F.lit(True).alias("_long")), "long-conversations")
    rows = rows.join(long, "conv_id", "left")
    dealt = ["conv_id", *(F.when(F.col("_long"), F.col(k)) for k in keys[1:])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, key, held = TaskContext.get().partitionId() << 32, None, []

        def close() -> tuple:
            nonlocal number, held
            text, states = raw_transcript(key, held)
            lines, _, gap = _lines(text, "none")
            number, held = number + 1, []
            return key, number, text, states, markers(lines)[1], gap

        for pdf in batches:
            out = []
            for conv_id, role, text in zip(pdf["conv_id"].tolist(), pdf["role"], pdf["text"], strict=True):
                if held and (conv_id != key or len(held) >= part):
                    out.append(close())
                key = conv_id
                held.append((role if isinstance(role, str) else None, text if isinstance(text, str) else None))
            yield pd.DataFrame(out, columns=_PIECE)
        if held:
            yield pd.DataFrame([close()], columns=_PIECE)

    return rows.repartitionByRange(n, *dealt).sortWithinPartitions(*keys).mapInPandas(c.freed(run), "conv_id long, piece long, text string, states array<string>, names array<string>, gap string")


_PIECE = ["conv_id", "piece", "text", "states", "names", "gap"]


def _scanned(rows: DataFrame, step, schema: str) -> DataFrame:
    """step over each conversation's rows in the order of its pieces: step(rows of one conversation)
    gives its output rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for pdf in batches for r in pdf.itertuples(index=False))
        out = []
        for _, group in itertools.groupby(each, key=lambda r: r.conv_id):
            for r in step(group):
                out.append(r)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    names = [x.split(" ")[0] for x in schema.split(", ")]
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "piece").mapInPandas(c.freed(run), schema)


def _carried(group) -> Iterator[tuple]:
    """What each piece has before it: its number, names, gap, the state before."""
    names, gap, before = [], "begin", None
    for number, r in enumerate(group):
        if number and gap != "begin":
            gap = "blank" if gap == "blank" or _apart(r.conv_id) else "none"
        yield r.conv_id, r.piece, number, list(names), gap, before
        names += [x for x in r.names if x not in names]
        names = names[:2]
        if r.last is not None:
            before, gap = STATES.index(tuple(r.last.split(" "))), r.gap
        elif gap == "none":
            gap = "blank"


def _joints(group) -> Iterator[tuple]:
    """The states in which the best path enters and leaves each piece, from the pieces' matrices."""
    best, seen, back = None, [], []
    for r in group:
        m = np.frombuffer(r.matrix).reshape(len(STATES), -1)
        step = m + (0 if best is None else best[:, None])
        back.append(step.argmax(axis=0).astype(np.int8))
        best = step.max(axis=0)
        seen.append((r.conv_id, r.piece))
    leave = int(best.argmax())
    for at in range(len(seen) - 1, -1, -1):
        enter = int(back[at][leave])
        yield *seen[at], enter, leave
        leave = enter


def _nexts(group) -> Iterator[tuple]:
    """Whether the last turn of each piece goes on in the next one."""
    before = None
    for r in group:
        if before is not None:
            yield *before, bool(r.goes_on)
        before = (r.conv_id, r.piece)
    yield *before, False


def parse_pieces(found: DataFrame, model: Model) -> DataFrame:
    """found: conv_id, piece, text, names, gap and number as `carried` gives them. Adds n_lines, line_roles, roles
    (of the turns that begin in the piece) and rendered: the pieces' texts one after the other are
    the rendered conversation."""

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [model.matrix(observe(t, tuple(n), g)[2], g == "begin").tobytes() for t, n, g in zip(pdf["text"], pdf["names"], pdf["gap"], strict=True)]
            yield pd.DataFrame({"conv_id": pdf["conv_id"], "piece": pdf["piece"], "matrix": out})

    joints = _scanned(found.select("conv_id", "piece", "text", "names", "gap").mapInPandas(c.freed(matrices), "conv_id long, piece long, matrix binary"), _joints, "conv_id long, piece long, enter int, leave int")
    rows = found.join(joints, ["conv_id", "piece"])
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items()) + ", n_lines long, line_roles array<string>, roles array<string>, body string, goes_on boolean"

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                lines, starts, feats = observe(r.text, tuple(r.names), r.gap)
                path, _ = model.viterbi(feats, None if r.gap == "begin" else r.enter, r.leave)
                own = _turns(lines, starts, feats, path)
                goes_on = bool(path) and r.gap != "begin" and STATES[path[0]][1] == "further"
                body = "\n<|end|>\n".join(("\n" if goes_on and not k else f"<|{role}|>\n") + _escaped(text) for k, (role, text) in enumerate(own))
                out.append((len(path), [STATES[s][0] for s in path], [x for x, _ in own[goes_on:]], body, goes_on))
            new = pd.DataFrame(out, columns=["n_lines", "line_roles", "roles", "body", "goes_on"], index=pdf.index)
            yield pd.concat([pdf[list(kinds)], new], axis=1)

    done = c.table(rows.mapInPandas(c.freed(decode), schema), "decoded")
    ends = _scanned(done.where("n_lines > 0").select("conv_id", "piece", "goes_on"), _nexts, "conv_id long, piece long, continued boolean")
    end = F.when(F.col("n_lines") == 0, F.lit("")).when(F.col("continued"), F.col("body")).otherwise(F.concat("body", F.lit("\n<|end|>\n")))
    return done.join(ends, ["conv_id", "piece"], "left").withColumn("rendered", end).select(*kinds, "n_lines", "line_roles", "roles", "rendered")


def carried(found: DataFrame) -> DataFrame:
    """pieces with number, names, gap and before: what stands before each piece."""
    last = F.when(F.size("states") > 0, F.element_at("states", -1)).alias("last")
    context = _scanned(found.select("conv_id", "piece", "names", "gap", last), _carried, "conv_id long, piece long, number long, names array<string>, gap string, before int")
    return found.drop("names", "gap").join(context, ["conv_id", "piece"])


def digest(conversations: DataFrame, part: int = PART) -> DataFrame:
    """Every conversation as a raw transcript, parsed back. The model learns from the conversations
    whose crc32(conv_id) is even; agreement is the share of lines whose role came back. A
    conversation of up to `part` turns is one row; longer ones are a row for each `part`, in order."""
    c.session(conversations.sparkSession)
    raw = c.table(carried(c.table(pieces(conversations, part), "pieces")), "transcripts")
    held_out = F.crc32(F.col("conv_id").cast("string")) % 2 == 1
    got = parse_pieces(raw.withColumn("held_out", held_out), train(raw.where(~held_out)))
    role = lambda s: F.element_at(F.split(s, " "), 1)
    right = F.size(F.filter(F.zip_with("line_roles", "states", lambda a, b: a == role(b)), lambda x: x))
    return got.select("conv_id", F.col("number").alias("part"), "held_out", "n_lines", F.size("roles").cast("long").alias("n_turns"), F.array_join("roles", ",").alias("roles"), F.when(F.col("n_lines") > 0, right / F.col("n_lines")).alias("agreement"), "rendered")
