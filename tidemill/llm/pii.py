"""Personal data by a semi-Markov conditional random field, on top of fixed patterns.

The field scores whole candidate spans (up to MOST_UNITS neighbouring units), so features can see all of a span: its
digit groups, checksum, separators, entropy, the words before it. Dynamic programming over bounded spans chooses
boundaries and types together, with weights for which types follow one another. It is trained here: the fixed patterns and a few secret formats label a bounded sample
of the corpus, and altered copies (other separators, missing prefixes) teach it what the patterns miss.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.llm.sample import smallest_hashes

KINDS = ["email", "ip", "card", "phone", "secret"]  # the first four have fixed patterns
SAMPLE, SECRETS, EPOCHS, RATE, MOST_UNITS, THRESHOLD = 600, 200, 5, 0.2, 8, 0.5
# the units that spans are made of: words with the marks that join them (so that an address or a number stays whole), and single
# other marks, so that a span can begin and end beside any bracket, quote or comma
UNIT = re.compile(r"\w+(?:[.%+@/\\-]+\w+)*|\S")
WORD_BEFORE = 4  # units before a span among which its last word is looked for
DIGITS = re.compile(r"[0-9]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEEDS = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:password|passwd|secret|api_key)=\S*[0-9]\S*|\btoken\s?=\s?\"[0-9A-Za-z]{16,}\"")
# the same matches in time linear in the text: a run of digits is entered at its start only, and never given back
IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# what makes a chunk worth a look: a digit, an at or equals sign, or a word that secrets come with, alone or before the next chunk
HOT = re.compile(r"[0-9@=]|[Pp]assw|PASSW|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi.?[Kk]ey|API.?KEY")
# What altered copies of the training texts put around a value.
ALTERED = {"email": [0], "ip": [0], "card": [0], "phone": [0, 3, 7], "secret": [0, 5, 7, 11, 16, 21, 22, 26]}  # which altered copies a value gets; secrets are rare
WRAPS = [("", ""), ("(", ")"), ('"', '"'), ("", ","), ('("', '")'), ("[", "]"), ("", ";"), ("<", ">")]
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Is the number at most 255, however many zeros lead it?"""
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find: leftmost and non-overlapping for each kind, checks applied afterwards."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            found.append((lo, end := m.end(), "email"))
        at = text.find("@", max(at + 1, end))
    if DIGITS.search(text):
        found += [(*m.span(), "ip") for m in IP_RUN.finditer(text) if all(map(octet, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 8 <= len(DIGITS.findall(m[0])) <= 15]
    return found


def chunk_at(text: str, at: int, least: int = 0) -> tuple[int, int]:
    """The maximal run without white space around a character, as far as it lies behind ``least``."""
    lo = hi = at
    while lo > least and not text[lo - 1].isspace():
        lo -= 1
    while hi < len(text) and not text[hi].isspace():
        hi += 1
    return lo, hi


def hot_chunks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring chunks around the hot ones; a chunk is a maximal run without white space. A chunk without digit,
    at or equals sign, that a word of secrets made hot, takes the next one along."""
    zone: list[tuple[int, int]] = []
    end = 0
    while m := HOT.search(text, end):
        lo, end = chunk_at(text, m.start(), end)
        if zone and lo - zone[-1][1] > 1:
            yield zone
            zone = []
        if not zone and lo and text[lo - 1].isspace():
            # up to two chunks before, as context
            for _ in range(2):
                first = zone[0][0] if zone else lo
                if first < 2 or not text[first - 1].isspace() or text[first - 2].isspace():
                    break
                zone.insert(0, chunk_at(text, first - 2))
        zone.append((lo, end))
        if m[0] not in "0123456789@=" and end + 1 < len(text) and not text[end + 1].isspace():
            zone.append(chunk_at(text, end + 1, end + 1))
            end = zone[-1][1]
    if zone:
        yield zone


def zones(text: str) -> Iterator[list[tuple[int, int]]]:
    """The units of each run of chunks, without those too far from a hot one to be in any candidate."""
    for chunks in hot_chunks(text):
        units = [m.span() for lo, hi in chunks for m in UNIT.finditer(text, lo, hi)]
        near, zone = -1, []
        last = [-1] * len(units)  # the place of the next hot unit from each one on
        for k in range(len(units) - 1, -1, -1):
            if HOT.search(text, *units[k]):
                near = k
            last[k] = near
        behind = -MOST_UNITS
        for k, unit in enumerate(units):
            if last[k] == k:
                behind = k
            if k - behind <= 1 or 0 <= last[k] < k + MOST_UNITS:
                zone.append(unit)
            elif zone:
                yield zone
                zone = []
        if zone:
            yield zone


def features(text: str, lo: int, hi: int, before: str, word: str = "") -> list[str]:
    """What the field sees of a candidate span."""
    s = text[lo:hi]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, letters = len(digits), sum(c.isalpha() for c in s)
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", s)))
    size = "0" if not n else "1-7" if n < 8 else "8-9" if n < 10 else "10-12" if n < 13 else "13-15" if n < 16 else "16-19" if n < 20 else "20+"
    out = ["one", f"n={size}", f"letters={min(3, letters)}", f"units={min(4, s.count(' ') + 1)}", f"first={'9' if s[0].isdigit() else 'a' if s[0].isalpha() else s[0]}", f"last={'9' if s[-1].isdigit() else 'a' if s[-1].isalpha() else s[-1]}"]
    groups = re.findall(r"[0-9]+", s)
    if not letters:
        out += [f"groups={min(6, len(groups))}", f"n={size},plain"]
        if n >= 13:
            out.append(f"luhn={luhn(digits)},{size}")
        if len(groups) == 4 and re.fullmatch(r"[0-9]+([.][0-9]+){3}", s):
            out.append(f"quad={all(octet(g) for g in groups)}")
        if 8 <= n <= 15:
            out.append(f"call={'+' in s},{'(' in s},{'-' in s}")
    if "@" in s:
        out.append(f"at={bool(re.fullmatch(r'[^@]+@[^@]+[.][A-Za-z]{2,}', s))}")
    if "=" in s:
        out.append("key=" + re.split(r"\s*=", s)[0].lower()[-12:])
    if letters and n and len(s) >= 12:
        share = len(set(s)) / len(s)
        out += [f"mixed={min(4, len(s) // 8)},{share > 0.4}", "hex" if re.fullmatch(r"[0-9a-f\"]+", s) else "nohex", "caps" if s.isupper() else "nocaps"]
    if len(shape) <= 12:
        out.append("shape=" + shape)
    if len(s) >= 12 and "=" not in s and " " not in s:
        out.append("bare")
    if before:
        out.append("before=" + before.lower()[-10:])
    if word:
        out.append("word=" + word.lower()[-10:])
    after = text[hi : hi + 1]
    out.append("after=" + ("9" if after.isdigit() else "a" if after.isalpha() else " " if after.isspace() else after))
    return out


class Field:
    """Weights of a semi-Markov field: ``weights[feature]`` has one value per kind, ``follow`` one per pair of neighbours."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS) + 1))  # the last index is "none", which also stands at the start

    def lattice(self, text: str, zone: list[tuple[int, int]]) -> list[tuple[int, int, int, int, list[str]]]:
        """Candidates (first unit, unit after, start, end, features): spans of up to MOST_UNITS neighbours of which the last is hot or
        follows a hot one; they begin and end at any unit. Their length in characters has no bound."""
        out = []
        hot = [bool(HOT.search(text, *chunk)) for chunk in zone]
        for i in range(len(zone)):
            ends = [j for j in range(i + 1, min(len(zone), i + MOST_UNITS) + 1) if hot[j - 1] or j > 1 and hot[j - 2]]
            if not ends:
                continue
            tail = lambda k: text[max(zone[k][0], zone[k][1] - 40) : zone[k][1]]
            before = tail(i - 1) if i else ""
            word = next((w for k in range(i - 1, max(-1, i - 1 - WORD_BEFORE), -1) if (w := tail(k))[-1].isalpha()), "")
            out += [(i, j, zone[i][0], zone[j - 1][1], features(text, zone[i][0], zone[j - 1][1], before, word)) for j in ends]
        return out

    def score(self, names: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in names:
            if (w := self.weights.get(f)) is not None:
                total += w
        return total

    def forward(self, n: int, arcs: list, scores: list[np.ndarray]) -> np.ndarray:
        """Log sums of all labelled segmentations up to each unit, by the last segment's kind."""
        none = len(KINDS)
        alpha = np.full((n + 1, none + 1), -np.inf)
        alpha[0, none] = 0
        ends: dict[int, list[int]] = {}
        for k, arc in enumerate(arcs):
            ends.setdefault(arc[1], []).append(k)
        for j in range(1, n + 1):
            alpha[j, none] = np.logaddexp.reduce(alpha[j - 1] + self.follow[:, none])
            for k in ends.get(j, ()):
                into = np.logaddexp.reduce(alpha[arcs[k][0]][:, None] + self.follow[:, :none], axis=0) + scores[k]
                alpha[j, :none] = np.logaddexp(alpha[j, :none], into)
        return alpha

    def backward(self, n: int, arcs: list, scores: list[np.ndarray]) -> np.ndarray:
        none = len(KINDS)
        beta = np.full((n + 1, none + 1), -np.inf)
        beta[n] = 0
        starts: dict[int, list[int]] = {}
        for k, arc in enumerate(arcs):
            starts.setdefault(arc[0], []).append(k)
        for i in range(n - 1, -1, -1):
            beta[i] = self.follow[:, none] + beta[i + 1, none]
            for k in starts.get(i, ()):
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(self.follow[:, :none] + scores[k] + beta[arcs[k][1], :none], axis=1))
        return beta

    def posteriors(self, n: int, arcs: list) -> list[np.ndarray]:
        return self.expected(n, arcs)[0]

    def expected(self, n: int, arcs: list) -> tuple[list[np.ndarray], np.ndarray]:
        """The probability of each candidate's kinds, and the expected number of times that each kind follows each."""
        none = len(KINDS)
        scores = [self.score(a[4]) for a in arcs]
        alpha, beta = self.forward(n, arcs, scores), self.backward(n, arcs, scores)
        z = np.logaddexp.reduce(alpha[n])
        follows = np.zeros_like(self.follow)
        follows[:, none] = np.exp(alpha[:-1] + self.follow[:, none] + beta[1:, none, None] - z).sum(axis=0)
        sure = []
        for arc, s in zip(arcs, scores):
            pairs = np.exp(alpha[arc[0]][:, None] + self.follow[:, :none] + s + beta[arc[1], :none] - z)
            follows[:, :none] += pairs
            sure.append(pairs.sum(axis=0))
        return sure, follows

    def train(self, examples: list[tuple[str, list[tuple[int, int]], dict[tuple[int, int], int]]]) -> None:
        """Stochastic gradient steps on the conditional likelihood of the labelled segmentations."""
        none = len(KINDS)
        ready = []
        for text, zone, gold in examples:
            arcs = self.lattice(text, zone)
            at, last, seen = 0, none, np.zeros_like(self.follow)
            starts = {a[0]: (a[1], gold[a[2:4]]) for a in arcs if a[2:4] in gold}
            while at < len(zone):
                to, kind = starts.get(at, (at + 1, none))
                seen[last, kind] += 1
                at, last = to, kind
            if arcs:
                ready.append((len(zone), arcs, gold, seen))
        for epoch in range(EPOCHS):
            rate = RATE / (1 + epoch)
            for n, arcs, gold, seen in ready:
                sure, follows = self.expected(n, arcs)
                self.follow += rate * (seen - follows)
                for arc, p in zip(arcs, sure):
                    step = -p
                    if (kind := gold.get(arc[2:4])) is not None:
                        step[kind] += 1
                    if np.abs(step).max() > 1e-3:
                        step *= rate
                        for f in arc[4]:
                            self.weights[f] = self.weights.get(f, 0) + step

    def best(self, n: int, arcs: list) -> list[tuple[int, int]]:
        """The (candidate, kind) of the best segmentation, by dynamic programming."""
        none = len(KINDS)
        best = np.full((n + 1, none + 1), -np.inf)
        best[0, none] = 0
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        scores = [self.score(a[4]) for a in arcs]
        ends: dict[int, list[int]] = {}
        for k, a in enumerate(arcs):
            ends.setdefault(a[1], []).append(k)
        for j in range(1, n + 1):
            via = best[j - 1] + self.follow[:, none]
            best[j, none], back[j, none] = via.max(), (j - 1, int(via.argmax()), -1)
            for k in ends.get(j, ()):
                step = best[arcs[k][0]][:, None] + self.follow[:, :none]
                total = step.max(axis=0) + scores[k]
                for kind in np.flatnonzero(total > best[j, :none]):
                    best[j, kind], back[j, int(kind)] = total[kind], (arcs[k][0], int(step[:, kind].argmax()), k)
        at, kind, chosen = n, int(best[n].argmax()), []
        while at:
            to, last, k = back[at, kind]
            if k >= 0:
                chosen.append((k, kind))
            at, kind = to, last
        return chosen

    def spans(self, text: str) -> list[Span]:
        """The best segmentation by dynamic programming; of its spans those with a posterior of THRESHOLD or more."""
        out = []
        for zone in zones(text):
            arcs = self.lattice(text, zone)
            if not arcs:
                continue
            n = len(zone)
            chosen = self.best(n, arcs)
            if chosen:
                sure = self.posteriors(n, arcs)
                out += [(arcs[k][2], arcs[k][3], KINDS[kind]) for k, kind in chosen if sure[k][kind] >= THRESHOLD]
        return out


def altered(text: str, span: Span, pick: int) -> tuple[str, Span]:
    """A copy of a text whose span is written in another way, so that the field learns more than the patterns, and its borders."""
    lo, hi, kind = span
    s, (left, right) = text[lo:hi], WRAPS[pick % len(WRAPS)]
    if kind == "phone":
        bare = re.sub(r"^\+[0-9]+\s?", "", s)
        s = [bare, s.replace("(", "").replace(")", ""), s.replace(" ", "-"), re.sub(r"[ ().]+", "-", bare).strip("-")][pick // 2 % 4]
    elif kind == "card":
        s = [" ".join(re.findall(r"[0-9]{1,4}", s)), "-".join(re.findall(r"[0-9]{1,4}", s)), s][pick % 3]
    elif kind == "secret":
        value = re.split(r"[=\s\"]+", s.strip('"'))[-1]
        letters = re.sub(r"[^A-Za-z]", "", value)
        if pick % 5 == 0 and len(letters) >= 8:
            s = ["secret=", "password=", "api_key=", "passwd="][pick // 5 % 4] + letters
        elif pick % 5 in (1, 2) and value:
            left, s = ["password is ", "key: ", "key: (", "the token is ", "secret: "][pick // 5 % 5], [value, value.upper()[:20], value[:13], "AK" + value.upper()[:18]][pick // 2 % 4]
            right = ")" if left.endswith("(") else right if right in (",", ";") else ""
    return text[:lo] + left + s + right + text[hi:], (lo + len(left), lo + len(left) + len(s), kind)


def seeded(text: str) -> list[Span]:
    """The base spans and what a few secret formats show, without the marks that end a sentence or a bracket behind them."""
    return base_spans(text) + [(m.start(), m.start() + len(m[0].rstrip(".,;:!?)]}>'")), "secret") for m in SEEDS.finditer(text)]


def train(docs: DataFrame) -> Field:
    """A field from the SAMPLE documents of smallest hash that hold a digit, an at or an equals sign, and, as secrets are rare, from the
    secrets of the SECRETS such documents that show one of the few formats; only these come to the driver."""
    short = docs.filter(F.length("text") <= 20_000)
    samples = [(smallest_hashes(short.filter(F.col("text").rlike(pattern)), ["doc_id", "text"], n, "text"), secrets) for pattern, n, secrets in (("[0-9@=]", SAMPLE, False), (SEEDS.pattern, SECRETS, True))]
    examples = []
    for number, (text, only_secrets) in enumerate((t, secrets) for texts, secrets in samples for t in texts):
        labelled = seeded(text)
        for chunks in hot_chunks(text):
            lo, hi = chunks[0][0], chunks[-1][1]
            inside = [(a - lo, b - lo, k) for a, b, k in labelled if a >= lo and b <= hi]
            if only_secrets and not any(k == "secret" for _, _, k in inside):
                continue
            versions = [(text[lo:hi], inside)]
            if len(inside) == 1:
                versions += [(t, [s]) for t, s in (altered(text[lo:hi], inside[0], number + n) for n in ALTERED[inside[0][2]])]
            for t, spans in versions:
                for z in zones(t):
                    # a zone whose labels don't begin and end at units can't be learned from
                    starts, ends = {u[0] for u in z}, {u[1] for u in z}
                    here = [(a, b, k) for a, b, k in spans if a < z[-1][1] and b > z[0][0]]
                    if all(a in starts and b in ends for a, b, _ in here):
                        examples.append((t, z, {(a, b): KINDS.index(k) for a, b, k in here}))
    field = Field()
    field.train(examples)
    return field


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (KINDS.index(s[2]), s[0], s[1])))


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and those that the field adds beside them (none that overlaps a base span)."""
    base = base_spans(text)
    # the stretches that base spans cover, so that one search tells whether a span meets any
    covered: list[list[int]] = []
    for a, b, _ in sorted(base):
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    free = lambda s: (k := bisect.bisect_left(covered, [s[1]])) == 0 or covered[k - 1][1] <= s[0]
    return base, [s for s in field.spans(text) if free(s)]


def personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_email, n_ip, n_card, n_phone`` (of the fixed patterns), ``base_sha256``, ``spans``, ``n_spans`` and ``redacted``.

    ``spans`` lists all spans as kind:start:end in code points, end exclusive, by kind, then start; ``redacted`` is the
    text with each replaced by its kind in brackets; ``n_spans`` counts them all. Very long texts, tokens and runs of digits
    take time linear in their length. Null texts count as empty and stay null when redacted. The field is
    trained on a bounded sample of the table (see ``train``); with no usable row it adds nothing. Repeated rows
    get equal results; other columns pass through; an empty table gives an empty result.
    """
    field = train(docs)
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "redacted"]
    held = [c for c in docs.columns if c not in names]
    rest = docs.select(*held)
    at = held.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = []
                for text in part.column(at).to_pylist():
                    base, extra = all_spans(text or "", field)
                    counts = [sum(s[2] == k for s in base) for k in KINDS[:4]]
                    clean, end = [], 0
                    for a, b, k in sorted(base + extra):
                        clean.append((text or "")[end : max(a, end)])
                        if b > end:
                            clean.append(f"[{k.upper()}]" if a >= end else "")
                        end = max(end, b)
                    rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + extra), len(base) + len(extra), None if text is None else "".join(clean) + text[end:]))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))], held + names)

    schema = StructType(list(rest.schema.fields))
    for n in names:
        schema = schema.add(n, "long" if n.startswith("n_") else "string")
    return rest.mapInArrow(run, schema)


def op6_semi_markov_pii(spark, sf_dir):
    """Personal data in every document."""
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")
