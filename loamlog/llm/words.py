"""Encoding of whole texts with the tokenizers library, repeated words once."""

from __future__ import annotations

import numpy as np

#: All white space characters.
BLANKS = [chr(i) for i in range(0x3001) if chr(i).isspace()]
#: Characters that a call to a tokenizer gets at once; memory of a task follows it.
BATCH_CHARS = 2_000_000


def batches_of(texts: list[str]):
    """Consecutive index ranges of about BATCH_CHARS characters each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BATCH_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class Index(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        at = self[key] = len(self)
        self.new.append(key)
        return at


class Encoder:
    """Encodes whole texts with the tokenizers library, repeated words only once.

    The tokenizers in use here split before every single space between two other
    characters and encodes what lies between such splits on its own. So the words of a text
    are looked up among those met before, and only new ones go through the library, in one
    text. Texts with wider white space or with a special token's string, and any text for a
    tokenizer that splits otherwise, go through the library whole.
    """

    #: Words kept at most. Frequent words come early, so later new ones are not kept.
    WORDS = 500_000

    def __init__(self, tokenizer, marker: str, by_word: bool, first_led: bool = False, reference=None, words: int | None = None):
        """``marker`` is how the vocabulary writes a leading space; ``by_word`` tells whether
        splitting at spaces holds for this tokenizer; ``first_led`` whether a text's first
        word is encoded as if a space stood before it. ``reference`` encodes texts with
        another library, to compare with whatever goes through this one."""
        self.tokenizer, self.by_word, self.first_led = tokenizer, by_word, first_led
        self.reference, self.most_words = reference, words or self.WORDS
        vocabulary = tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if max(vocabulary.values(), default=0) < 65536 else np.dtype("<u4")
        self.led_by_space = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.led_by_space[i] = token.startswith(marker)
        self.special = [marker, *(t.content for t in tokenizer.get_added_tokens_decoder().values())]
        self.index, self.ids = Index(), np.zeros(0, self.dtype)
        self.starts = np.zeros(1, np.int64)
        self.agreed = np.zeros(0, bool)

    def irregular(self, text: str) -> bool:
        """Whether a space stands next to white space or an end, or a special string occurs."""
        if text[0] == " " or text[-1] == " ":
            return True
        return any(c in text and (c + " " in text or " " + c in text) for c in BLANKS) or any(x in text for x in self.special)

    def whole(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of texts that the library gets whole, and whether the reference agrees.

        Where it does not, the ids are the reference's.
        """
        out = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        agreed = [True] * len(texts)
        if self.reference is not None and texts:
            for i, want in enumerate(self.reference(texts)):
                want = np.array(want, self.dtype)
                if not np.array_equal(out[i], want):
                    out[i], agreed[i] = want, False
        return out, agreed

    def learn(self) -> None:
        new, self.index.new = self.index.new, []
        if not new:
            return
        lead = "" if self.first_led else " "
        parts, agreed = self.whole([lead + " ".join(new[i : i + 500]) for i in range(0, len(new), 500)])
        ids = np.concatenate(parts)
        starts = np.flatnonzero(self.led_by_space[ids])
        if len(starts) != len(new):
            raise ValueError("the tokenizer does not split at spaces as its description says")
        self.starts = np.concatenate([self.starts[:-1], len(self.ids) + starts, [len(self.ids) + len(ids)]])
        self.ids = np.concatenate([self.ids, ids])
        self.agreed = np.concatenate([self.agreed, np.repeat(agreed, 500)[: len(new)]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_checked(texts)[0]

    def encode_checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether the reference agrees on all that the text is made of."""
        out: list = [None] * len(texts)
        good = [True] * len(texts)
        regular = [i for i, t in enumerate(texts) if t and self.by_word and not self.irregular(t)]
        rest = sorted(set(range(len(texts))) - set(regular))
        for i, ids, same in zip(rest, *self.whole([texts[i] for i in rest]), strict=True):
            out[i], good[i] = ids, same
        words, firsts, counts = [], [], []
        for i in regular:
            more = texts[i].split(" ")
            if not self.first_led:
                firsts.append(more.pop(0))
            counts.append(len(more))
            words += more
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new = self.index.new
        self.learn()
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - lengths), lengths)]
        edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        cuts = np.concatenate([[0], ends])[edges]
        wrong = np.concatenate([[0], np.cumsum(~self.agreed[at])])[edges]
        heads = ([flat[:0]] * len(regular), [True] * len(regular)) if self.first_led else self.whole(firsts)
        for k, (i, ids, same) in enumerate(zip(regular, *heads, strict=True)):
            out[i] = np.concatenate([ids, flat[cuts[k] : cuts[k + 1]]])
            good[i] = same and bool(wrong[k] == wrong[k + 1])
        if len(self.index) > self.most_words:
            for word in new:
                del self.index[word]
            self.starts = self.starts[: known + 1]
            self.ids = self.ids[: self.starts[-1]]
            self.agreed = self.agreed[:known]
        return out, good
