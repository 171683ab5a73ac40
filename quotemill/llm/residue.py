"""Template residue, filler, error pages and script notices in the place of content."""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm import residue_exemplars as given
from quotemill.session import ship

#: Kinds that stand for a whole text, the last of them only beside the others.
KINDS = ("error", "script", "filler", "chrome")
#: A word marks a mention only from this weight on: words that many documents use anyway don't.
MENTION_WEIGHT = 3.0
#: Passages are judged in windows of so many words, each beginning half a window after the one before.
WINDOW = 40
#: Words of a leading name or title.
LEAD = 4

#: How the slots of the labelled placeholders read.
_SLOTS = {
    "FIELD": r"[\p{L}_][\p{L}\p{N}_.\-]*",
    "TEXT": r"[^{}<>]+",
    "TEXT?": r"[^{}<>]*",
    "LINE": r"[^\[\]()<>*|\n]+",
    "NAME": r"(?P<name>[\p{L}_][\p{L}\p{N}]*(?:[ _.\-]+[\p{L}\p{N}]+)*)",
}
#: HTML elements, which stand in angle brackets as fields do.
_ELEMENTS = frozenset(
    "a abbr article aside b body br button code div em figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link main meta nav ol option p pre s script section select small span strong style sub sup svg table tbody td th thead title tr u ul video".split()
)
_MORE_ELEMENTS = frozenset(
    "acronym address area audio base bdi bdo big blockquote canvas caption center cite col colgroup data datalist dd del details dfn dialog dl dt embed fieldset figcaption frame frameset g hgroup ins kbd legend map mark menu meter noscript object optgroup output param path picture progress q rect rp rt ruby samp search slot source strike summary template textarea tfoot time track tt var wbr".split()
)
_ADDRESS = regex.compile(r"(?i)^(?:www\.|\S*\.(?:com|org|net|gov|edu|io|co|uk|de|fr|es|eu|info|html?|php|pdf)$)")
#: A long "[... here]" with one of these points to another text.
_LINK = regex.compile(r"(?i)\b(?:click|tap|read|see|view|visit|watch|listen|download|find|found|available|published|posted|appeared|reproduced|reprinted)\b")
_FIELDS = frozenset(given.FIELDS.split())
_EDITORIAL, _PREPOSITIONS = frozenset(given.EDITORIAL.split()), frozenset(given.PREPOSITIONS.split())
_SENTENCE = regex.compile(r"(?<=[.!?…。！？])\s+|[\r\n]+")
_SPACED = regex.compile(r"(?<![\p{L}\p{N}])(?:[\p{L}] ){3,}[\p{L}](?![\p{L}\p{N}])")
#: The words of WORD, by the faster standard module.
_TOKEN = re.compile(r"[^\W_]+")
_DIGIT = regex.compile(r"\p{N}")
#: Any run of one character stands for all such runs: xxx, 0000, aaaa.
RUN = "⁣run"


def plain(text: str) -> str:
    """text with compatibility forms, case, invisible characters and letter-spacing evened out."""
    t = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).translate(_INVISIBLE).lower()
    return _SPACED.sub(lambda m: m.group(0).replace(" ", ""), t)


_INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])


def tokens(passage: str) -> list[str]:
    return [RUN if w[0] == w[-1] and len(w) > 1 and w == w[0] * len(w) else w for w in _TOKEN.findall(passage)]


class Placeholder:
    """A labelled placeholder as a token: its signs and fixed words, and a slot of the kind that it names."""

    def __init__(self, exemplar: str):
        self.token = "\u2063slot " + exemplar
        parts = re.split(r"(TEXT\?|TEXT|FIELD|LINE|NAME)", exemplar)
        #: What a text must hold for the token to be in it.
        self.opening = parts[0].strip().lower()
        body = "".join(_SLOTS.get(x) or re.sub(r"\\ |\s", lambda m: r"\s" if parts[0].strip()[-1:].isalpha() or parts[-1].strip()[:1].isalpha() else r"[-\s]*", re.escape(x)) for x in parts)
        first, last = exemplar[0], exemplar[-1]
        # Signs that go on outside are other signs; within a word no bracket opens a field. Fixed words inside tell by themselves.
        free = first == "%" or any(c.isalpha() for c in "".join(x for x in parts if x not in _SLOTS))
        before = "" if free else r"(?<![\p{L}\p{N}" + re.escape(first) + r"])" if len(self.opening) == 1 else "(?<!" + re.escape(first) + ")"
        after = r"(?![\p{L}\p{N}(\[:])" if exemplar == "[NAME]" else "" if free else "(?!" + re.escape(last) + ")"
        self.named = "NAME" in parts
        self.found = regex.compile("(?i)" + before + body + after).finditer


def exemplars(extra: Sequence[tuple[str, str]] = ()) -> list[tuple[str, frozenset[str]]]:
    """(kind, words) of all labelled exemplars; extra are (kind, text). Besides KINDS there are placeholders, whose word is their token, and mentions."""
    lines = [("error", x) for x in given.STATUSES.splitlines()] + [("error", x.partition(" ")[2]) for x in given.STATUSES.splitlines()]
    lines += [(k, x) for k, block in zip(KINDS, (given.ERROR, given.SCRIPT, given.FILLER, given.CHROME)) for x in block.splitlines()]
    lines += [("filler", given.LATIN.replace("\n", " ")), *[x for x in extra if x[0] != "placeholder"]]
    lines += [("mention", x) for x in given.MENTION.split()]
    out = [(k, frozenset(tokens(plain(x)))) for k, x in lines]
    # A text of nothing but runs of one character is filler.
    out.append(("filler", frozenset([RUN])))
    out += [("placeholder", frozenset([Placeholder(x).token])) for x in [*given.PLACEHOLDER.splitlines(), *[x for k, x in extra if k == "placeholder"]]]
    return list(dict.fromkeys((k, w) for k, w in out if w))


class _Weights(dict):
    """Weight of every word met; numbers and codes say little, words the exemplars don't have count as typical ones."""

    def __init__(self, known: dict[str, float], other: float):
        super().__init__(known)
        self.other = other

    def __missing__(self, w: str) -> float:
        x = self.other * 0.1 if _DIGIT.search(w) else self.other
        if len(self) < 500_000:
            self[w] = x
        return x


class Matcher:
    """Exemplars behind an inverted index, with the weights of words in the corpus."""

    def __init__(self, found: list[tuple[str, frozenset[str]]], weights: dict[str, float], other: float):
        self.found, self.weights, self.other = found, weights, other
        self.weight = _Weights(weights, other).__getitem__
        self.index: dict[str, list[int]] = {}
        for k, (_, words) in enumerate(found):
            for w in words:
                self.index.setdefault(w, []).append(k)
        self.heavy = [sum(self.weight(w) for w in words) for _, words in found]
        #: Words of exemplars that stand for a whole text.
        self.known = frozenset(w for kind, words in found if kind in KINDS for w in words)
        self.placeholders = [Placeholder(next(iter(words)).removeprefix("\u2063slot ")) for kind, words in found if kind == "placeholder"]

    def retrieved(self, words: set[str], kinds: Sequence[str]) -> dict[int, float]:
        """The exemplars of some kinds that share a word with a window, and the weight of what they share."""
        shared: dict[int, float] = {}
        for w in words:
            x = None
            for k in self.index.get(w, ()):
                if self.found[k][0] in kinds:
                    if x is None:
                        x = self.weight(w)
                    shared[k] = shared.get(k, 0.0) + x
        return shared

    def covered(self, window: list[str]) -> dict[str, bool]:
        """Words of the window that matching exemplars account for; True where one of them is not chrome."""
        words = set(window)
        shared = self.retrieved(words & self.known, KINDS)
        if not shared:
            return {}
        total = sum(map(self.weight, words))
        out: dict[str, bool] = {}
        for k, s in shared.items():
            kind, mine = self.found[k]
            # Containment of the exemplar in the window, or of the window in the exemplar.
            if s >= 0.65 * self.heavy[k] or s >= 0.75 * total:
                core = kind != "chrome"
                for w in words & mine:
                    out[w] = out.get(w, False) or core
        return out

    def coverage(self, text: str, lead: int = LEAD) -> tuple[float, float]:
        """Part of the text's weight that exemplars account for, and the part that core ones do. Up to `lead` words before the first covered one are set aside as a name or title."""
        flat: list[tuple[str, int]] = []
        opening = True
        for passage in _SENTENCE.split(plain(text)):
            ws = tokens(passage)
            marks = [0] * len(ws)
            for at in range(0, max(1, len(ws) - WINDOW // 2), WINDOW // 2):
                part = ws[at : at + WINDOW]
                got = self.covered(part)
                if opening and part:
                    # A name may stand before the first passage without a stop between them.
                    after = next((i for i, w in enumerate(part) if w in self.known), 0)
                    if 0 < after <= lead:
                        for w, core in self.covered(part[after:]).items():
                            got[w] = got.get(w, False) or core
                    opening = False
                if got:
                    for i, w in enumerate(part, at):
                        if w in got:
                            marks[i] = max(marks[i], 2 if got[w] else 1)
            flat += zip(ws, marks)
        first = next((i for i, (_, m) in enumerate(flat) if m), None)
        if first is None:
            return 0.0, 0.0
        if first <= lead:
            flat = flat[first:]
        # One word in common is no sign, unless it is all there is.
        if len({w for w, m in flat if m == 2}) < 2 and any(m != 2 for _, m in flat):
            return 0.0, 0.0
        weighed = [(self.weight(w), m) for w, m in flat]
        total = sum(x for x, _ in weighed) or 1.0
        return sum(x for x, m in weighed if m) / total, sum(x for x, m in weighed if m == 2) / total

    def could_cover(self, words: list[str], least: float, lead: int = LEAD) -> bool:
        """False if not even all words known to the exemplars would reach the least coverage. Whatever part of the first `lead` words is set aside, the weight that remains is no less than that of the others."""
        weight = self.weight
        total = sum(map(weight, words))
        return sum(map(weight, filter(self.known.__contains__, words))) >= least * (total - sum(map(weight, words[:lead]))) - 1e-9

    def unfilled(self, text: str) -> int:
        """Placeholders that stand for a value: those whose exemplar, but none of a mention, the passage around them retrieves, and that it doesn't quote."""
        low = text.lower()
        hits = sorted((m.start(), -m.end(), k) for k, p in enumerate(self.placeholders) if p.opening in low for m in p.found(text) if not p.named or self._field_like(m, text))
        n, upto = 0, 0
        for a, b, k in hits:
            b = -b
            if a < upto:
                continue
            upto = b
            lo = max(text.rfind("\n", 0, a), *(text.rfind(x, 0, a) for x in (". ", "! ", "? "))) + 1
            ends = [e for e in (text.find(x, b) for x in ("\n", ". ", "! ", "? ")) if e >= 0]
            hi = min(ends, default=len(text))
            passage = {self.placeholders[k].token, *_TOKEN.findall(text[lo:a].lower()), *_TOKEN.findall(text[b:hi].lower())}
            kinds = {self.found[e][0] for e, s in self.retrieved(passage, ("placeholder", "mention")).items() if s >= (0.65 * self.heavy[e] if self.found[e][0] == "placeholder" else max(MENTION_WEIGHT, self.heavy[e]))}
            if kinds == {"placeholder"} and not self._points(text[a:b]) and not self._quoted(text[lo:a], text[b:hi]):
                n += 1
        return n

    @staticmethod
    def _points(found: str) -> bool:
        """Whether a long "[... here]" points to another text."""
        return found.lower().endswith(" here]") and len(found) > 47 and bool(_LINK.search(found))

    def _field_like(self, m: regex.Match, text: str) -> bool:
        """Whether words in single brackets pass for the name of a field."""
        name, a, b = m.group("name"), m.start("name"), m.end()
        low = name.lower()
        usual = all(w in _FIELDS for w in re.split(r"[ _.\-]+", low) if w)
        if m.group().startswith("<"):
            if low in _ELEMENTS:
                return False
            if usual or regex.fullmatch(r"\p{Lu}[\p{Lu}\p{N}_]*", name):
                return True
            if low.split(" ")[0] in _ELEMENTS | _MORE_ELEMENTS or "</" + name + ">" in text[b:]:
                return False
        elif usual:
            return True
        elif text[a - 2 : a - 1] == "]":
            return False
        return len(name) > 1 and not _ADDRESS.search(name) and not self._editorial(name, text[text.rfind("\n", 0, a) + 1 : a - 1])

    @staticmethod
    def _editorial(name: str, before: str) -> bool:
        """Whether words in brackets are a remark or insertion of an editor, or a ticker after its company; before is the line up to them."""
        if "_" in name:
            return False
        words = re.split(r"[ .\-]+", name.lower())
        if words[0] in _PREPOSITIONS or any(w in _EDITORIAL for w in words):
            return True
        # Within a quotation of any length they are the editor's.
        opening, closing = ("„", "“") if "„" in before else ("“", "”")
        if before.count('"') % 2 or before.rfind(opening) > before.rfind(closing) or before.rfind("«") > before.rfind("»"):
            return True
        last = before.split()[-1:]
        return len(name) <= 5 and name.isupper() and bool(last) and last[0][0].isupper() and last[0].lower() not in _EDITORIAL | _PREPOSITIONS

    @staticmethod
    def _quoted(before: str, after: str) -> bool:
        """Within a short quotation."""
        for opening, closing in (('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("»", "«"), ("`", "`")):
            i = before.rfind(opening)
            j = after.find(closing)
            if i < 0 or j < 0 or len((before[i:] + after[:j]).split()) > 7:
                continue
            if opening == closing:
                if before.count(opening) % 2 == 1:
                    return True
            elif before.rfind(closing) < i:
                return True
        return False


@functools.lru_cache(maxsize=2)
def _matcher(found: tuple, weights: tuple, other: float) -> Matcher:
    return Matcher(list(found), dict(weights), other)


def word_weights(df: DataFrame, vocabulary: Sequence[str], *, text: str = "text") -> tuple[dict[str, float], float]:
    """Inverse document frequencies, over all documents, of the words of the exemplars, and the one of a word met in one of 200. As many numbers as the exemplars have words, whatever the corpus."""
    wanted = frozenset(vocabulary)

    def run(batches):
        n, of = 0, dict.fromkeys(wanted, 0)
        for b in batches:
            for t in b.column(0).to_pylist():
                if t is not None:
                    n += 1
                    for w in wanted.intersection(_TOKEN.findall(t.lower())):
                        of[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *of]), pa.array([n, *of.values()], type=pa.int64())], names=["w", "n"])

    found = df.select(text).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n")).collect()
    of = {r[0]: r[1] for r in found}
    n = of.get("", 0)
    weight = lambda k: math.log((n + 1) / (k + 1)) + 0.5
    return {w: weight(of.get(w, 0)) for w in vocabulary}, weight(max(1, n // 200))


def residue_marks(df: DataFrame, *, key: str = "doc_id", text: str = "text", extra: Sequence[tuple[str, str]] = (), least: float = 0.5, least_core: float = 0.25) -> DataFrame:
    """key, unfilled (placeholders left), coverage, core, residue (boolean) of every document.

    A document is residue if a placeholder was left in it, or if exemplars of filler, error
    pages or script notices account for at least `least` of its weight and those that are
    not mere page chrome for at least `least_core`, a leading name or title set aside.
    Weights are inverse document frequencies over all documents. A passage window
    retrieves exemplars through an inverted index by the words they share; an exemplar
    matches if it is contained in the window, or the window in it, by TF-IDF weight.
    Labelled placeholders are exemplars too, each with its signs and slot as one token of
    the weight of a rare word. One that a passage retrieves is left unfilled unless the
    passage also retrieves an exemplar of a mention, or it stands in a short quotation;
    words in single brackets must also have the form of a field's name. Texts are read
    whole; a text none of whose passages could reach the coverage is told from its words
    alone, by a bound that is never below the coverage. extra takes further exemplars of
    any kind, placeholders with FIELD, TEXT, LINE or NAME where the value goes.

    Null, empty and blank texts are no residue, with coverage 0. Repeated rows are marked
    each; a null key stays null. An empty table gives no rows; extra columns are ignored.
    """
    ship(df.sparkSession)
    found = exemplars(extra)
    vocabulary = {w for kind, words in found if kind != "placeholder" for w in words}
    weights, other = word_weights(df, sorted(vocabulary), text=text)
    frozen = (tuple(found), tuple(sorted(weights.items())), other)

    def run(batches):
        m = _matcher(*frozen)
        for b in batches:
            unfilled, cover, core = [], [], []
            for t in b.column("__text").to_pylist():
                if not t or not t.strip():
                    unfilled.append(0), cover.append(0.0), core.append(0.0)
                    continue
                unfilled.append(m.unfilled(t))
                c = m.coverage(t) if m.could_cover(tokens(plain(t)), least) else (0.0, 0.0)
                cover.append(c[0]), core.append(c[1])
            yield pa.RecordBatch.from_arrays([b.column("__key"), pa.array(unfilled, type=pa.int32()), pa.array(cover, type=pa.float64()), pa.array(core, type=pa.float64())], names=["__key", "unfilled", "coverage", "core"])

    kind = dict(df.dtypes)[key]
    marks = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"__key {kind}, unfilled int, coverage double, core double")
    return marks.select(F.col("__key").alias(key), "unfilled", "coverage", "core", ((F.col("unfilled") > 0) | ((F.col("coverage") >= least) & (F.col("core") >= least_core))).alias("residue"))
