"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text accepts exactly its substrings. A text
is parsed into the longest phrases that occur in that language's text; the language that
needs the fewest phrases, normalised by the length of text and training text, wins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import bounded_sample, resident, slices, small_batches

#: Symbol 0 parts training texts, 1 is any run of other characters, the last is a letter that
#: no training text has. Up to LETTERS letters have a symbol each. Of more, the most frequent
#: do, and each further one is written as three digits, the first of DIGITS symbols of its own.
ALPHABET, DIGITS = 64, 16
LETTERS = ALPHABET - 3
#: Symbols parsed side by side as one lane; the state at its end goes on into the next one.
LANE = 256
#: Breaks per symbol over which no learned language accounts for a text.
MOST_BREAKS = 0.5
#: Characters worked on at once.
PIECE = 600_000


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % modulus == remainder


def suffix_automaton(text: np.ndarray) -> np.ndarray:
    """Transition table of the automaton of all substrings, flattened.

    Values are next states times ALPHABET. Where a state has no transition the complement of
    the root's transition is stored, so that a sign tells the end of a phrase. The last row
    is the state to start from.
    """
    size = 2 * len(text) + 4  # two states of its own at the end; rows that no state uses are never touched
    table = np.empty((size, ALPHABET), np.int32)
    table[0] = -1
    link, length = [-1] * size, [0] * size
    last, states = 0, 1
    for c in text.tolist():
        new = states
        states += 1
        table[new] = -1
        length[new] = length[last] + 1
        p = last
        while p >= 0 and table[p, c] < 0:
            table[p, c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = int(table[p, c])
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = states
                states += 1
                table[twin] = table[q]
                link[twin], length[twin] = link[q], length[p] + 1
                while p >= 0 and table[p, c] == q:
                    table[p, c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    # two states more: after a symbol that the text lacks, where any symbol starts a phrase,
    # and before the first symbol, where none ends one
    lone = np.int64(states) * ALPHABET
    root = np.where(table[0] < 0, lone, table[0].astype(np.int64) * ALPHABET).astype(np.int32)
    for a in range(0, states, 4096):  # in place: a copy of each table would be the worker's peak
        part = table[a : min(a + 4096, states)]
        part[:] = np.where(part < 0, ~root, part * np.int32(ALPHABET))
    table[states], table[states + 1] = ~root, root
    return table[: states + 2].ravel()


class Parser:
    """The automata of all languages, and the counting of phrases against each."""

    def __init__(self, training: tuple[tuple[str, tuple[str, ...]], ...]):
        self.languages = [k for k, _ in training]
        letters: dict[str, int] = {}
        for _, texts in training:
            for t in texts:
                for ch in t.lower():
                    if ch.isalpha():
                        letters[ch] = letters.get(ch, 0) + 1
        order = sorted(letters, key=lambda ch: (-letters[ch], ch))
        own = LETTERS if len(order) <= LETTERS else LETTERS - 2 * DIGITS
        self.symbol = np.fromiter((ALPHABET - 1 if chr(i).isalpha() else 1 for i in range(0x110000)), np.uint8, 0x110000)
        self.further = np.zeros((0x110000, 2), np.uint8)
        for i, ch in enumerate(order):
            rank = i - own
            self.symbol[ord(ch)] = i + 2 if rank < 0 else 2 + own + rank // DIGITS**2 % DIGITS
            if rank >= 0:
                self.further[ord(ch)] = 2 + own + DIGITS + np.array([rank // DIGITS % DIGITS, rank % DIGITS])
        self.tables, self.bits = [], []
        for _, texts in training:
            parts = [np.append(self.symbols([t])[0], np.uint8(0)) for t in texts]
            text = np.concatenate(parts) if parts else np.zeros(1, np.uint8)
            self.tables.append(suffix_automaton(text))
            self.bits.append(math.log2(len(text) + 1))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the texts end to end with runs of other characters as one, and lengths."""
        low = [t.lower() for t in texts]
        sizes = np.array([len(t) for t in low], np.int64)
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.symbol[points]
        owner = np.repeat(np.arange(len(texts)), sizes)
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != 1) | (out[:-1] != 1) | (owner[1:] != owner[:-1])
        out, owner, points = out[keep], owner[keep], points[keep]
        more = self.further[points]
        if more.any():
            every = np.concatenate([out[:, None], more], axis=1).ravel()
            some = every > 0
            out, owner = every[some], np.repeat(owner, 3)[some]
        return out, np.bincount(owner, minlength=len(texts))

    def count(self, texts: list[str], states: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Phrases (texts x languages), symbols and letters of each text, and the automata's
        states at the texts' ends; ``states`` are those to start from, if texts go on.

        Lanes of a text are parsed side by side from fresh starts. Then each lane is entered
        with the state at the end of the lane before, up to where its own parse is met; a lane
        whose last state changes by that sends the next one again.
        """
        symbols, sizes = self.symbols(texts)
        starts = np.cumsum(sizes) - sizes
        lanes = -(-sizes // LANE)
        first_lane = np.cumsum(lanes) - lanes
        owner = np.repeat(np.arange(len(texts)), lanes)
        at = (np.arange(lanes.sum()) - np.repeat(first_lane, lanes)) * LANE
        lane_start, lane_size = starts[owner] + at, np.minimum(sizes[owner] - at, LANE)
        # longest lanes first, so that those with a symbol at a step stand in front
        order = np.argsort(-lane_size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner, lane_start, lane_size, head = owner[order], lane_start[order], lane_size[order], at[order] == 0
        before_lane = place[np.maximum(order - 1, 0)]
        last = np.append(head[place][1:], True)[order] if len(order) else head
        after_lane = place[np.minimum(order + 1, len(order) - 1)] if len(order) else place
        active = np.searchsorted(-lane_size, -np.arange(LANE), side="left")
        padded = np.append(symbols, np.zeros(LANE, np.uint8))
        grid = padded[lane_start[None, :] + np.arange(LANE)[:, None]]
        phrases = np.zeros((len(texts), len(self.tables)), np.int64)
        ends = []
        for k, table in enumerate(self.tables):
            root = len(table) - ALPHABET
            before = np.full(len(texts), root, np.int32) if states is None else states[k]
            met = np.zeros((LANE, len(owner)), np.int32)
            ended = np.zeros((LANE, len(owner)), np.int8)
            state = np.full(len(owner), root, np.int32)
            for step in range(int(lane_size.max(initial=0))):
                n = active[step]
                to = table[state[:n] + grid[step, :n]]
                sign = to >> 31
                ended[step, :n] = -sign
                state[:n] = met[step, :n] = to ^ sign
            # entered anew: lanes after another one, and first lanes of texts that go on
            again = np.flatnonzero(~head | (before[owner] != root))
            while len(again):
                open_, now = again, np.where(head[again], before[owner[again]], state[before_lane[again]])
                changed = []
                for step in range(LANE):
                    done = lane_size[open_] <= step
                    if done.any():
                        changed.append((open_[done], now[done]))
                        open_, now = open_[~done], now[~done]
                    if not len(open_):
                        break
                    to = table[now + grid[step, open_]]
                    sign = to >> 31
                    ended[step, open_] = -sign
                    now = to ^ sign
                    differs = met[step, open_] != now
                    met[step, open_] = now
                    open_, now = open_[differs], now[differs]
                if len(open_):
                    changed.append((open_, now))
                if not changed:
                    break
                lane = np.concatenate([x for x, _ in changed])
                state[lane] = np.concatenate([x for _, x in changed])
                again = np.unique(after_lane[lane[~last[lane]]])
            phrases[:, k] = np.bincount(owner, ended.sum(axis=0), len(texts))
            end = before.copy()
            end[owner[last]] = state[last]
            ends.append(end)
        letters = np.bincount(np.repeat(np.arange(len(texts)), sizes), symbols >= 2, len(texts))
        return phrases, sizes, letters, ends

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ``und`` with score 0 where there is no letter."""
        return self.parse(texts)[:2]

    def parse(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
        """Language, score and breaks of each text.

        Breaks are the ends of phrases per symbol in the language of fewest phrases: null
        without a letter, 0 if no language was learned.
        """
        n = len(texts)
        broken = np.zeros((n, len(self.tables)), np.float64)
        sizes, letters = np.zeros(n), np.zeros(n)
        for owners, parts in pieces(texts):
            states = None
            for part in parts:
                p, s, c, states = self.count(part, states)
                np.add.at(broken, owners, p)
                np.add.at(sizes, owners, s)
                np.add.at(letters, owners, c)
        if not self.tables:
            return ["und"] * n, [0.0] * n, [0.0 if c else None for c in letters.tolist()]
        cost = (broken + (sizes > 0)[:, None]) * np.array(self.bits)
        best = cost.argmin(axis=1)
        two = np.sort(cost, axis=1)[:, :2]
        score = np.ones(n) if two.shape[1] == 1 else np.clip(1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0, 1)
        known = letters > 0
        breaks = broken.min(axis=1) / np.maximum(sizes, 1)
        return (
            [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)],
            np.where(known, score, 0.0).tolist(),
            [b if k else None for b, k in zip(breaks.tolist(), known.tolist(), strict=True)],
        )


def pieces(texts: list[str | None]):
    """(owners, parts): texts of some PIECE characters together in one part; a longer text
    alone, in several parts that follow one another. Parts end after a letter or the text."""
    owners, held, size = [], [], 0
    for i, t in enumerate(texts):
        if t and len(t) > PIECE:
            cuts = [0]
            while len(t) - cuts[-1] > PIECE:
                end = cuts[-1] + PIECE
                while end < len(t) and not (t[end - 1].isalpha() or t[end].isalpha()):
                    end += 1
                cuts.append(end)
            yield [i], [[t[a:b]] for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True) if b > a]
        elif t:
            owners.append(i)
            held.append(t)
            size += len(t)
            if size >= PIECE:
                yield owners, [held]
                owners, held, size = [], [], 0
    if owners:
        yield owners, [held]


def parser(training: tuple) -> Parser:
    return resident("languages", training, lambda: Parser(training))


def spans(text: Column, chars: int, parts: int = 4) -> Column:
    """``parts`` equal pieces spread evenly over a text, ``chars`` in all; shorter ones whole."""
    size = chars // parts
    at = lambda i: F.floor((F.length(text) - size) * i / (parts - 1)) + 1
    pieces_ = F.array(*[F.substr(text, at(F.lit(i)).cast("int"), F.lit(size)) for i in range(parts)])
    return F.when(F.length(text) <= chars, F.array(text)).otherwise(pieces_)


def sample_training(labelled: DataFrame, docs_per_language: int, chars_per_doc: int) -> tuple:
    """(language, pieces of text) from a bounded sample of labelled rows: of each language
    ``docs_per_language`` different texts at most, the ones of smallest hash, and of each
    ``chars_per_doc`` characters at most, in pieces spread over the whole text."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    chosen = bounded_sample(rows.select("lang", "h"), "lang", "h", docs_per_language)
    if not chosen:
        return ()
    # at most docs_per_language rows for each language that is learned: small by parameter
    wanted = F.broadcast(labelled.sparkSession.createDataFrame(chosen, "lang string, h long"))
    found = rows.join(wanted, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", spans(F.col("text"), chars_per_doc).alias("parts")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        out.setdefault(r["lang"], []).extend(r["parts"])
    return tuple((k, tuple(v)) for k, v in out.items() if any(ch.isalpha() for t in v for ch in t))


def identify(
    docs: DataFrame, labelled: DataFrame, docs_per_language: int = 48, chars_per_doc: int = 800, into: tuple[str, ...] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the language and its score (0 to 1, 1 less the ratio of the two best costs)
    in the columns ``into``, which replace columns of these names; a third name takes the breaks.

    ``labelled`` (doc_id, text, lang) is only sampled. Texts that are null or have no letter
    get ``und`` and 0; so does every text if nothing was learned. Only ``text`` is an input
    of the prediction. Extra columns pass through.
    """
    small_batches(docs.sparkSession)
    training = docs.sparkSession.sparkContext.broadcast(sample_training(labelled, docs_per_language, chars_per_doc))
    at = docs.columns.index("text")
    schema = docs.drop(*into).withColumns({into[0]: F.lit(""), into[1]: F.lit(0.0)} | {c: F.lit(None).cast("double") for c in into[2:]}).schema
    names = [c for c in docs.columns if c not in into]

    def predict(batches):
        for batch in (part for whole in batches for part in slices(whole, at, PIECE, model=True)):
            languages, *numbers = parser(training.value).parse(batch.column(at).to_pylist())
            held = [batch.column(docs_at[c]) for c in names]
            yield pa.record_batch([*held, pa.array(languages, pa.string()), *(pa.array(x, pa.float64()) for x in numbers[: len(into) - 1])], names=[*names, *into])

    docs_at = {c: i for i, c in enumerate(docs.columns)}
    return docs.mapInArrow(predict, schema)


def identify_documents(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the rest."""
    out_of = held_out(F.col("doc_id"), modulus, remainder)
    labelled = docs.where(~out_of)
    return identify(docs.select("doc_id", "text"), labelled).select("doc_id", out_of.alias("held_out"), "lang_pred", "score")
