"""Personal data by a semi-Markov conditional random field.

A text is cut to tokens (runs of ASCII letters and digits, single other characters) around triggers: digits, ``@``, key
words such as ``password=``, and access keys. Candidate segments of at most MAX_TOKENS tokens and MAX_CHARS characters,
and unbroken runs of any length, are scored by features of the whole span (its shape, checksums, digits, context) and by
the kind of the segment that ends where it starts; a Viterbi pass over the bounded segments chooses boundaries and kinds
jointly. The weights are fitted here by gradient ascent on the conditional likelihood of generated sentences (``fit``),
which takes seconds, once in a process, and always gives the same.

Spans that pass the exact rules of ``rule_spans`` are segments that the field must keep: they are always in the result,
marked ``base``; the field adds spans between them. A span that it adds holds a digit or ``@``, or follows a key word, or
is an access key; text without any trigger has no span.

Null and empty texts have no spans. Long texts are scanned whole, in time in proportion to their length; no pattern
backtracks over more than its own match. Segments that lose to tokens of no kind whatever stands beside them are left
out, and what does not overlap or touch is decoded by itself, so a text of numbers costs 5 to 30 CPU seconds and some
20 MB of memory for each MB; only numbers that touch without end, as in ``+1(2) +1(2)``, are decoded together, at some 600 bytes a character. The input's columns are kept, those named like an added one are replaced;
repeated rows are scanned each; an empty table gives an empty one.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import islice, takewhile

import numpy as np
from pyspark.sql import DataFrame

from .common import with_python

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Longest segment in tokens and in characters, unless it is an unbroken run, and how far around a trigger tokens are looked at.
MAX_TOKENS, MAX_CHARS, AROUND = 24, 96, 40

DIGIT_OR_AT = re.compile(r"[0-9@]")
#: Digits, @, access keys of letters, and = and : (which count after a key word only); one class of first characters scans fast.
TRIGGER = re.compile(r"[0-9@=:A](?:(?<=[0-9@])[0-9@]*|(?<=[=:])|(?<=A)[A-Z]{19})")
ALNUM = re.compile(r"[A-Za-z0-9]*")
RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_+/.~-]*")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def is_card(span: str) -> bool:
    digits = NOT_DIGIT.sub("", span)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_ip(span: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards, so a long word costs no more than its length."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        back = text[done:at][::-1] if at - done < 64 else None
        if back is None:  # only as far as the run of local characters goes
            step = 64
            while step < at - done and LOCAL_END.match(text[at - step : at][::-1]).end() == step:
                step *= 2
            back = text[max(done, at - step) : at][::-1]
        start = at - LOCAL_END.match(back).end()
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans of the exact rules, sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if is_card(m[0])]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


MAIL_LIKE = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@.]{2,}")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
GROUPED = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
DIALLED = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")
DATED = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}")
KEYED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|key)[\"']?[ \t]*[=:][ \t]*[\"']?$")
ACCESS = re.compile(r"A[A-Z]{3}[A-Z0-9]{16}")
MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9]{12,}")


def keyed(text: str, at: int) -> bool:
    """Whether a key word with = or : ends at this place; only 24 characters before it are read."""
    low = max(0, at - 4)
    return (text.find("=", low, at) >= 0 or text.find(":", low, at) >= 0) and KEYED.search(text, max(0, at - 24), at) is not None


HEX = re.compile(r"[0-9a-fA-F]+")

N_FEATURES = 34
NONE = len(KINDS)  # the label of a token in no segment


def beside(c: str, known: str) -> int:
    """0 for nothing or white space, 1 for a character of ``known``, 2 for another."""
    return 0 if not c or c.isspace() else 1 if c in known else 2


BEFORE, AFTER = "\"'=:(<[,", "\"').,;:>]!?"


def features(text: str, start: int, end: int, tokens: int, led: bool) -> list[int]:
    """Numbers of the features that the span has; they look at the whole span and at what stands beside it. ``led``: a key word stands before it."""
    span = text[start:end]
    digits = NOT_DIGIT.sub("", span)
    n, size = len(digits), end - start
    on = [0, 1 + min(6, (n > 0) + (n > 6) + (n > 9) + (n > 11) + (n > 15) + (n > 19))]
    on.append(8 + (tokens > 1) + (tokens > 5) + (tokens > 9))
    if "@" in span and MAIL_LIKE.fullmatch(span):
        on.append(12)
    if n and QUAD.fullmatch(span):
        on.append(13 if is_ip(span) else 14)
    if n and GROUPED.fullmatch(span):
        on.append(15 if is_card(span) else 16)
    if n == 10 and DIALLED.fullmatch(span):
        on.append(17)
    if span[0] == "+" and 9 <= n <= 15 and PHONE.fullmatch(span):
        on.append(18)
    if size < 11 and DATED.fullmatch(span):
        on.append(19)
    if span[0] == "+":
        on.append(20)
    if led:
        on.append(21)
        if RUN.fullmatch(span):
            on.append(28 + (size > 7))
        if not n:
            on.append(30 + (text[start - 1 : start] in "=\"'"))
    if size == 20 and ACCESS.fullmatch(span):
        on.append(22)
    if tokens == 1 and size > 11 and MIXED.fullmatch(span):
        on.append(23)
    if size >= 32 and RUN.fullmatch(span):
        on.append(33 if HEX.fullmatch(span) else 32)
    before, after = beside(text[start - 1 : start], BEFORE), beside(text[end : end + 1], AFTER)
    if before:
        on.append(23 + before)
    if after:
        on.append(25 + after)
    return on


#: Classes of tokens: digits, letters and digits, a blank, others that may stand within a segment, a run longer than any other segment, the rest.
DIGITS, MIX, BLANK, INNER, LONG, REST = range(6)
#: What may stand between the letters and digits of a segment.
WITHIN = "@._%+-() /~"
KIND_OF = {c: INNER for c in WITHIN} | {" ": BLANK}


def tokens_of(text: str, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, class, run) of the tokens in text[low:high]; run: where a run of over 20 characters that starts there has its last
    letter or digit, else 0. A run that is longer than any other segment is one token, as nothing starts or ends within it."""
    runs = ((m.start(), m.start() + len(m[0].rstrip("_+/.~-"))) for m in RUN.finditer(text, low, high) if m.end() - m.start() > 20)
    at = low
    while at < high:
        s, e = next(runs, (high, high))
        to = e if e - s <= MAX_CHARS else s
        for m in TOKEN.finditer(text, at, to):
            word = m[0]
            kind = DIGITS if word.isdecimal() else MIX if word.isalnum() else KIND_OF.get(word, REST)
            yield m.start(), m.end(), kind if kind > MIX or word.isascii() else REST, e if m.start() == s else 0
        if to < e:
            yield s, e, LONG, e
        at = e


def segments(text: str, low: int, high: int, blocked: list[tuple[int, int]], look, ahead: int = 4096) -> Iterator[tuple[int, int, object]]:
    """(start, end, what ``look`` makes of it) of the candidate segments of text[low:high], by their start.

    A segment starts with a letter, digit, + or (, ends with a letter or digit, holds a digit or @, or follows a key word, or
    is an access key, holds of other characters ``WITHIN`` only, does not cut a run of letters and digits, and does not overlap
    ``blocked``. Whole runs are segments of any length. ``look(start, end, tokens, letters, led)`` gives None for those to leave out.
    Some thousand tokens are held at a time.
    """
    stream, held, over, reach = tokens_of(text, low, high), [], iter(blocked), 0
    ahead_of = next(over, None)
    while True:
        more = []
        for s, e, kind, run in islice(stream, ahead):
            while ahead_of and ahead_of[0] < e:
                reach, ahead_of = max(reach, ahead_of[1]), next(over, None)
            more.append((s, e, kind, run, reach > s))
        held += more
        last = len(held) if not more else max(0, len(held) - MAX_TOKENS)
        for i in range(last):
            start, end, kind, run, taken = held[i]
            if taken or kind > MIX and kind != LONG and text[start] not in "+(":
                continue
            led = keyed(text, start)
            known = False
            if kind != LONG:
                blanks, letters, marked, before = 0, False, False, kind
                for j in range(i, min(len(held), i + MAX_TOKENS)):
                    _, end, kind, _, taken = held[j]
                    if taken or kind >= LONG or end - start > MAX_CHARS and j > i:
                        break
                    if kind == BLANK:
                        blanks += 1
                        if blanks > 4 or before == BLANK:
                            break
                    before = kind
                    if kind > MIX:
                        marked = marked or text[end - 1] == "@"
                        continue
                    if kind == MIX:
                        if blanks and not DIGIT_LED.match(text, held[j][0]):
                            break  # words after a blank belong to no kind
                        letters = True
                        marked = marked or DIGIT_LED.search(text, held[j][0], end) is not None
                    else:
                        marked = True
                    if marked or led and not blanks or j == i and ACCESS.fullmatch(text, start, end):
                        known = known or end == run
                        if (found := look(start, end, j - i + 1, letters, led)) is not None:
                            yield start, end, found
            if run and not known and (DIGIT_OR_AT.search(text, start, run) or led):  # as it is, up to its last letter or digit
                if kind == LONG or not _overlaps(held, i, run):
                    tokens = sum(1 for _ in TOKEN.finditer(text, start, run))
                    if (found := look(start, run, tokens, True, led)) is not None:
                        yield start, run, found
        if not more:
            return
        del held[:last]


def _overlaps(held: list, i: int, end: int) -> bool:
    """Whether a token from the i-th up to ``end`` overlaps what is blocked; a run of at most MAX_CHARS is held as a whole."""
    while i < len(held) and held[i][0] < end:
        if held[i][4]:
            return True
        i += 1
    return False


def lattice(text: str, low: int, high: int, blocked: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token borders in text[low:high], and candidate segments (first token, end token, features), ordered by their end."""
    borders = [low, *(m.end() for m in TOKEN.finditer(text, low, high))]
    found = segments(text, low, high, blocked, lambda start, end, tokens, letters, led: features(text, start, end, tokens, led))
    return borders, sorted(((bisect_left(borders, s), bisect_left(borders, e), on) for s, e, on in found), key=lambda x: (x[1], x[0]))


DIGIT_LED = re.compile(r"[0-9]")
AS_ZERO = str.maketrans("123456789", "0" * 9)


class Field(tuple):
    """(weights, steps), with the scores of feature sets and of shapes of numbers that it has met (KNOWN of each at most)."""

    KNOWN = 1 << 16

    def __init__(self, pair: tuple[np.ndarray, np.ndarray]):
        steps = pair[1]
        self.by_features: dict[tuple, tuple] = {}
        self.by_shape: dict[tuple, tuple] = {}
        self.plain_steps = steps.tolist()
        before, after = steps[:, :NONE] - steps[:, [NONE]], steps[:NONE] - steps[NONE]
        #: What a segment of a kind gains by its neighbours, against as many tokens of no kind: with none beside it, or at most, by
        #: whether a segment can touch it before and after.
        left, right = (before[NONE], before.max(0)), (after[:, NONE], np.maximum(after.max(1), 0))
        self.slack = np.array([x + y for x in left for y in right])

    def scores(self, on: list[int]) -> tuple[list[float], list[float]]:
        """The score of each kind, and the highest with what it can gain, for each row of ``slack``."""
        key = tuple(on)
        if key not in self.by_features:
            if len(self.by_features) >= self.KNOWN:
                self.by_features.clear()
            score = self[0][:, on].sum(1)
            self.by_features[key] = score.tolist(), (score + self.slack).max(1).tolist()
        return self.by_features[key]

    def looker(self, text: str, high: int):
        """For ``segments`` up to ``high``: scores of the kinds, or None for one that loses to tokens of no kind whatever stands beside it.

        Segments end with a letter or digit, so they touch only where the next one starts with + or (.
        """
        none = self.plain_steps[NONE][NONE]

        def look(start: int, end: int, tokens: int, letters: bool, led: bool) -> list[float] | None:
            if letters or led or end - start > 40:
                score, most = self.scores(features(text, start, end, tokens, led))
            else:  # of a number only its shape and its checks count
                shape = text[start:end].translate(AS_ZERO)
                n, fine = shape.count("0"), None
                if 12 <= n <= 19 and GROUPED.fullmatch(shape):
                    fine = is_card(text[start:end])
                elif QUAD.fullmatch(shape):
                    fine = is_ip(text[start:end])
                key = shape, fine, beside(text[start - 1 : start], BEFORE), beside(text[end : end + 1], AFTER)
                if key not in self.by_shape:
                    if len(self.by_shape) >= self.KNOWN:
                        self.by_shape.clear()
                    self.by_shape[key] = self.scores(features(text, start, end, tokens, led))
                score, most = self.by_shape[key]
            touch = 2 * (text[start] in "+(") + (end == high or text[end] in "+(")
            return score if most[touch] >= (tokens - 1) * none else None

        return look


def decoded(counts: list[int], found: list[tuple[int, int, list[float]]], steps: list[list[float]]) -> list[tuple[int, int, int]]:
    """The best segmentation: (first point, end point, kind). Between points k and k + 1 stand ``counts[k]`` tokens; a token in no segment scores 0.

    ``found``: (first point, end point, score of each kind), by end, then start. ``steps``: score of a label after another,
    NONE among them; the state of a point is the label of what ends there.
    """
    least, labels = float("-inf"), range(NONE + 1)
    none = steps[NONE][NONE]
    reach, come, back = [], [], []  # by point: best score and label before, by the label after; (point, label) before, by the label that ends there
    at = 0
    for j in range(len(counts) + 1):
        best, before = [least] * NONE, [None] * (NONE + 1)
        best.append(reach[j - 1][NONE] + (counts[j - 1] - 1) * none if j else 0.0)
        before[NONE] = (j - 1, come[j - 1][NONE]) if j else None
        some = False
        while at < len(found) and found[at][1] == j:
            i, _, score = found[at]
            into = reach[i]
            for k in range(NONE):
                if into[k] + score[k] > best[k]:
                    best[k], before[k], some = into[k] + score[k], (i, come[i][k]), True
            at += 1
        back.append(before)
        if some:
            chosen = [max(labels, key=lambda a: best[a] + steps[a][b]) for b in labels]
            come.append(chosen)
            reach.append([best[a] + steps[a][b] for b, a in enumerate(chosen)])
        else:  # only NONE can end here
            come.append([NONE] * (NONE + 1))
            reach.append([best[NONE] + x for x in steps[NONE]])
    out, j, label = [], len(counts), max(labels, key=best.__getitem__)
    while j:
        i, earlier = back[j][label]
        if label != NONE:
            out.append((i, j, label))
        j, label = i, earlier
    return out[::-1]


def viterbi(n: int, found: list, weights: np.ndarray, steps: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation of n tokens by the segments of a lattice: (first token, end token, kind)."""
    return decoded([1] * n, [(i, j, weights[:, on].sum(1).tolist()) for i, j, on in found], steps.tolist())


def islands(found: Iterator[tuple[int, int, list[float]]]) -> Iterator[list[tuple[int, int, list[float]]]]:
    """Segments that overlap or touch, together; between two islands stands a token of no kind, so each is decoded by itself."""
    held, reach = [], -1
    for one in found:
        if held and one[0] > reach:
            yield held
            held = []
        held.append(one)
        reach = max(reach, one[1])
    if held:
        yield held


def chosen(text: str, island: list[tuple[int, int, list[float]]], high: int, steps: list[list[float]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best segmentation of an island and of the token after it, if one comes before ``high``."""
    points = sorted({p for s, e, _ in island for p in (s, e)})
    counts = [sum(1 for _ in TOKEN.finditer(text, a, b)) for a, b in zip(points, points[1:])]
    place = {p: k for k, p in enumerate(points)}
    found = sorted(((place[s], place[e], score) for s, e, score in island), key=lambda x: (x[1], x[0]))
    return [(points[i], k, points[j]) for i, j, k in decoded(counts + [1] * (points[-1] < high), found, steps)]


def regions(text: str) -> list[tuple[int, int]]:
    """Where to look: around triggers, merged, not cutting a run of letters and digits; every character is passed once."""
    found: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if m[0] in "=:" and not keyed(text, m.end()):
            continue
        done = found[-1][1] if found else 0
        high = min(len(text), m.end() + AROUND)
        if high <= done:
            continue
        low = max(0, m.start() - AROUND)
        while low > done and _ascii(text[low - 1]) and _ascii(text[low]):
            low -= 1
        if high < len(text) and _ascii(text[high - 1]):
            high = ALNUM.match(text, high).end()
        if found and low <= done:
            found[-1][1] = high
        else:
            found.append([low, high])
    return [(a, b) for a, b in found]


def _ascii(c: str) -> bool:
    return c.isascii() and c.isalnum()


def find(text: str, model: Field) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base) of all spans, sorted."""
    base = rule_spans(text) if DIGIT_OR_AT.search(text) else []
    found = [(*s, True) for s in base]
    held = 0
    for low, high in regions(text):
        while held < len(base) and base[held][2] <= low:
            held += 1
        blocked = [(s, e) for s, _, e in takewhile(lambda b: b[0] < high, islice(base, held, None))]
        for island in islands(segments(text, low, high, blocked, model.looker(text, high))):
            found += [(*span, False) for span in chosen(text, island, high, model.plain_steps)]
    return sorted(set(found))


def sentences(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences and their (start, kind, end): spans of all kinds, and numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("aeiourstnlhdm", k=r.randint(2, 8)))
    num = lambda k: "".join(r.choices("0123456789", k=k))

    def card(ok: bool) -> str:
        while True:
            digits = "4" + num(15)
            if luhn(digits) == ok:
                return digits if r.random() < 0.6 else r.choice(" -").join(digits[i : i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str, str, int]:
        kind = r.randrange(5)
        if kind == 0:
            return "", f"{word()}{r.choice(['.', '_', ''])}{num(2)}@{word()}.{r.choice(['com', 'org', 'example.net'])}", 0
        if kind == 1:
            return "", ".".join(str(r.randrange(256)) for _ in range(4)), 1
        if kind == 2:
            return "", card(True), 2
        if kind == 3:
            return "", r.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+49 {num(3)} {num(7)}"]), 3
        x = r.random()
        if x < 0.3:
            return "", "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" if x < 0.2 else "ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=16)), 4
        if x < 0.45:
            return r.choice(["password=", "secret=\"", "pwd='", "token=", "api_key="]), "".join(r.choices("aeiourstnlhdmkvbg", k=r.randint(8, 28))), 4
        if x < 0.6:
            return r.choice(["key: ", "token: ", "secret = ", "api_key=", "password: ", ""]), ".".join("".join(r.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789_-", k=r.randint(30, 70))) + "k7" for _ in range(r.choice([1, 1, 3]))), 4
        if x < 0.7:
            return r.choice(["key: ", "sha=", ""]), "".join(r.choices("0123456789abcdef", k=r.choice([64, 128]))), 4
        return r.choice(["password=", "token = \"", "api_key: ", "secret="]), num(1) + "".join(r.choices("0123456789abcdef", k=r.randint(15, 39))), 4

    plain = lambda: r.choice([num(r.randint(1, 6)), num(16), card(False), f"{num(4)}-0{num(1)}-1{num(1)}", f"{num(1)}.{num(1)}", f"{num(3)}.{num(3)}.{num(3)}.{400 + r.randrange(500)}", f"{num(2)}%", f"{num(3)} {num(3)}", word() + num(2), "@" + word(), f"{r.choice(['key', 'token', 'secret', 'password'])}: {word()}{r.choice([word(), ''])}", f"key={word()[:7]}", f"the {r.choice(['key', 'token', 'password'])} {word()}", f"{word()}{word()}{word()}{word()}", f"https://{word()}.org/{word()}/{word()}-{word()}/{num(4)}", num(24), f"{num(2)}:{num(2)}"])
    made = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(6, 12)):
            x = r.random()
            if x < 0.2:
                lead, body, kind = entity()
                spans.append((len(text) + len(lead), kind, len(text) + len(lead) + len(body)))
                text += lead + body + ("\"" if lead.endswith("\"") else r.choice(["", "", ".", ","])) + " "
            else:
                text += (plain() if x < 0.4 else word()) + r.choice([" ", " ", ", ", ". "])
        made.append((text, spans))
    return made


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    most = np.where(np.isfinite(most), most, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


def _sums(values: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Logarithms of the sums of exp(values) by ``to``, row by row; -inf where there is none."""
    most = np.full((n, values.shape[1]), -np.inf)
    np.maximum.at(most, to, values)
    sums = np.zeros_like(most)
    np.add.at(sums, to, np.exp(values - np.where(np.isfinite(most), most, 0)[to]))
    with np.errstate(divide="ignore"):
        return np.log(sums) + np.where(np.isfinite(most), most, 0)


@cache
def fit(n: int = 200, rounds: int = 20, rate: float = 0.5) -> Field:
    """Weights (kind, feature) and steps (label, label after it) by gradient ascent on the conditional log-likelihood of
    ``sentences``, with forward and backward sums over all sentences side by side; fitted once in a process."""
    size, rows, gold_on, pairs = [], [], np.zeros((NONE, N_FEATURES)), np.zeros((NONE + 1, NONE + 1))
    for at, (text, spans) in enumerate(sentences(n)):
        borders, found = lattice(text, 0, len(text), [])
        size.append(len(borders) - 1)
        by_place = {(borders[i], borders[j]): (i, j, on) for i, j, on in found}
        gold = {}
        for s, kind, e in spans:
            if (s, e) in by_place:
                i, j, on = by_place[s, e]
                gold[i] = j, kind
                gold_on[kind, on] += 1
        before, j = NONE, 0
        while j < len(borders) - 1:
            j, label = gold.get(j, (j + 1, NONE))
            pairs[before, label] += 1
            before = label
        rows += [(at, i, j, on) for i, j, on in found]
    size, most = np.array(size), max(size)
    who, first, end = (np.array([r[k] for r in rows]) for k in range(3))
    on = np.zeros((len(rows), N_FEATURES))
    for k, r in enumerate(rows):
        on[k, r[3]] = 1
    ending, starting = ([np.flatnonzero(x == j) for j in range(most + 1)] for x in (end, first))
    every = np.arange(n)
    shapes = (NONE, N_FEATURES), (NONE + 1, NONE + 1)
    weights, steps = (np.zeros(s) for s in shapes)
    memory = [np.full(s, 1e-6) for s in shapes]
    weights[:, 0] = -2
    for _ in range(rounds):
        scores = on @ weights.T
        forward = np.full((n, most + 1, NONE + 1), -np.inf)  # up to a border, by the label of what ends there
        into = np.empty_like(forward)  # ... by the label of what starts there
        forward[:, 0, NONE] = 0
        for j in range(most + 1):
            if j:
                forward[:, j, NONE] = into[:, j - 1, NONE]
                forward[:, j, :NONE] = _sums(into[who[ending[j]], first[ending[j]], :NONE] + scores[ending[j]], who[ending[j]], n)
            into[:, j] = _sum(forward[:, j, :, None] + steps, 1)
        backward, start = np.full_like(forward, -np.inf), np.full_like(forward, -np.inf)
        backward[every, size] = 0
        for i in range(most - 1, -1, -1):
            start[:, i, NONE] = backward[:, i + 1, NONE]
            start[:, i, :NONE] = _sums(scores[starting[i]] + backward[who[starting[i]], end[starting[i]], :NONE], who[starting[i]], n)
            found = _sum(steps + start[:, i, None, :], 2)
            backward[:, i] = np.where((i < size)[:, None], found, backward[:, i])
        total = backward[:, 0, NONE]
        slopes = [-0.02 * weights + gold_on, -0.02 * steps + pairs]
        slopes[0] -= np.exp(into[who, first, :NONE] + scores + backward[who, end, :NONE] - total[who, None]).T @ on
        within = np.arange(most) < size[:, None]
        slopes[1] -= np.exp((forward[:, :-1, :, None] + steps + start[:, :-1, None, :] - total[:, None, None, None])[within]).sum(0)
        for x, slope, m in zip((weights, steps), slopes, memory, strict=True):
            m += slope**2
            x += rate * slope / np.sqrt(m)
    return Field((weights, steps))


def spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and ``spans``: ARRAY<STRUCT<kind, start, end, base>> by start, then kind as in KINDS; code points, end exclusive."""
    model = fit()
    one = lambda value: ([{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in find(value, model)],)
    return with_python(df, text, [("spans", "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")], lambda: one)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind, as ``[EMAIL]``; overlapping spans are replaced together by the first's. Null becomes empty."""
    model = fit()

    def one(value: str) -> tuple[str]:
        out, done = [], 0
        for start, kind, end, _ in find(value, model):
            if start >= done:
                out += [value[done:start], f"[{KINDS[kind].upper()}]"]
            done = max(done, end)
        return ("".join([*out, value[done:]]),)

    order = df.columns
    return with_python(df, text, [(text, "string")], lambda: one).select(*[f"`{c}`" for c in order])
