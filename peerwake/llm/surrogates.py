"""Personal data replaced by surrogates that keep type, script, gender and format.

Detected: e-mail addresses, telephone, card and social-security numbers, IPv4 addresses, IBANs,
named secrets, long hexadecimal tokens, names after a title and their other mentions in the text. An entity is its type and its
canonical value (lower case, or digits only), so different spellings of one number or address
share one surrogate. The surrogate is drawn by HMAC-SHA256 from a key, the type and the value:
digits become digits, letters letters of their case, card numbers keep their first digit and a
right check digit, IBANs country and check digits, names the gender of their title and script.

Distinctness is checked over the whole corpus: no two entities of a type get one surrogate, and no
surrogate is an entity that occurs. Losers draw again until none is left; what a round keeps is
written before the next. Every ``WIDEN`` rounds surrogates of secrets, addresses and names grow by a character
or syllable, so mostly punctuated values find free ones too; kinds of fixed form have 10^8 values or more.
A run that finds none in ``ROUNDS`` rounds fails. A row of punctuation isn't a secret. Entities and texts meet by joins, so a hot entity or text is split by the
engine; only texts that hold candidates are shuffled, copies of a text once.

Defined results: null texts stay null, texts without entities stay as they are; rows and all
columns are kept (``n_chars``, where present, is the new text's length). Repeated rows stay.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checkpoints import staged
from .common import arrow_map, packed, small_batches, unpacked

KEY = b"surrogate-key-of-the-test-tables"
#: Rounds of draws after which free text grows by a character or syllable, and rounds after which ``assign`` gives up.
WIDEN, ROUNDS = 4, 200
#: Titles and the gender they tell (fixed values).
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Doña": "f",
          "Dr": "", "Prof": ""}
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_CAPITAL = "[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]"
_REST = r"(?:[^\W\d_]|['’-](?=[^\W\d_]))"
#: A text without a match of this (in the JVM) has no entity.
CANDIDATE = r"[0-9@]|(?i:token|secret|passw|key)|\b(?:" + _TITLE + r")\b"
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}(?![A-Za-z0-9-]))"
    r"|(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)\b[\"']?\s{0,4}[=:]\s{0,4}[\"']?)(?P<secret>(?=[_\-+/=.]*+[A-Za-z0-9])[A-Za-z0-9_\-+/=.]{8,}+)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<card>(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\5\d{4}\5\d{1,7})(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w])(?!\.\d))"
    r"|(?P<phone>(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w))"
    r"|(?P<hex>\b(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)\b)"
    rf"|\b(?P<title>{_TITLE})\b\.? (?P<name>{_CAPITAL}{_REST}+(?: {_CAPITAL}{_REST}+){{0,2}}\b)")
#: One, two or three capitalised words, from any of them; the groups end behind each.
MENTION = re.compile(rf"(?<![\w'’-])(?=({_CAPITAL}{_REST}+(?![\w'’-]))(?:( {_CAPITAL}{_REST}+(?![\w'’-]))( {_CAPITAL}{_REST}+(?![\w'’-]))?)?)")
KINDS = ("email", "secret", "iban", "card", "ssn", "ip", "phone", "hex", "name")
#: Syllables of invented names, by script: onsets, vowels, and endings by gender (fixed values).
SCRIPTS = {"latin": ("b d f g k l m n p r s t v".split(), "a e i o u".split(), {"m": "on", "f": "ia", "": "en"}),
           "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split(), {"m": "ов", "f": "ова", "": "ко"}),
           "greek": ("β γ δ κ λ μ ν π ρ σ τ φ".split(), "α ε ι ο".split(), {"m": "ος", "f": "α", "": "ι"})}


def canonical(kind: str, value: str) -> str:
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", value)
        return digits[1:] if kind == "phone" and len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind == "email" else value.casefold() if kind == "name" else value


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, canonical value, gender) of each entity, in order.

    A name that stands behind a title somewhere in the text is found at its other places too.
    """
    out, names = [], {}
    for m in PATTERN.finditer(text):
        kind = next(k for k in KINDS if m.group(k) is not None)
        value, gender = m.group(kind), TITLES[m["title"]] if kind == "name" else ""
        if kind == "name":
            names.setdefault(value, gender)
        out.append((*m.span(kind), kind, canonical(kind, value), gender))
    return _with_later_mentions(text, out, names) if names else out


def _with_later_mentions(text: str, found: list[tuple], names: dict[str, str]) -> list[tuple]:
    """``found`` and the places of ``names`` (with their genders) outside of it: one walk over the text's capitalised words."""
    more, at, end = [], 0, 0
    for m in MENTION.finditer(text):
        while at < len(found) and found[at][1] <= m.start():
            at += 1
        if m.start() < end:
            continue
        stops = {m.end(k) for k in (1, 2, 3) if m.group(k)}
        stops |= {x - 2 for x in stops if text[x - 2:x] in ("'s", "’s")}
        for stop in sorted(stops, reverse=True):
            value = text[m.start():stop]
            if value in names and (at == len(found) or found[at][0] >= stop):
                more.append((m.start(), stop, "name", canonical("name", value), names[value]))
                end = stop
                break
    return sorted([*found, *more])


class _Draw:
    """Keyed numbers, as many as are asked for."""

    def __init__(self, key: bytes, *parts):
        self.key, self.seed, self.block, self.held = key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return x % n

    def pick(self, items):
        return items[self.below(len(items))]


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    doubled = [int(d) * (2 - i % 2) for i, d in enumerate(reversed(digits))]
    return -sum(d // 10 + d % 10 for d in doubled) % 10


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _like(value: str, draw: _Draw, more: int = 0) -> str:
    """``value`` with other letters and digits, and ``more`` characters behind it."""
    value += "a" * more
    hexadecimal = len(value) >= 16 and not value.isdigit() and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
    letters = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
    either = "0123456789" + letters
    if hexadecimal:
        return "".join(draw.pick(either.upper() if value.isupper() else either) for _ in value)
    return "".join(draw.pick("0123456789") if c.isdigit() else draw.pick(letters.upper()) if "A" <= c <= "Z" else draw.pick(letters) if c.isalpha() else c for c in value)


def surrogate(kind: str, value: str, gender: str, attempt: int, key: bytes = KEY) -> str:
    """The canonical surrogate of an entity."""
    draw = _Draw(key, kind, value, attempt)
    digits = lambda n: "".join(draw.pick("0123456789") for _ in range(n))
    if kind == "email":
        name, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_like(name, draw, attempt // WIDEN)}@{_like(host, draw)}.{top}"
    if kind == "phone":
        country, local = value[:-10], value[-10:]
        return country + "".join(draw.pick("23456789") if i in (0, 3) else draw.pick("0123456789") for i in range(len(local)))
    if kind == "card":
        body = value[0] + digits(len(value) - 2)
        return body + (str(luhn(body)) if luhn(value[:-1]) == int(value[-1]) else digits(1))
    if kind == "ip":
        return ".".join(str(1 + draw.below(223) if i == 0 else draw.below(256)) for i in range(4))
    if kind == "ssn":
        return digits(len(value))
    if kind == "iban":
        rest = _like(value[4:], draw)
        return value[:2] + _iban_check(value[:2], rest) + rest
    if kind == "name":
        script = "cyrillic" if re.search("[а-я]", value) else "greek" if re.search("[α-ω]", value) else "latin"
        onsets, vowels, endings = SCRIPTS[script]
        stem = lambda n: "".join(draw.pick(onsets) + draw.pick(vowels) for _ in range(n))
        parts = [stem(3 + attempt // WIDEN) for _ in value.split(" ")]
        return " ".join([parts[0] + draw.pick(onsets) + endings[gender], *parts[1:]])
    return _like(value, draw, attempt // WIDEN)


def render(kind: str, surface: str, value: str) -> str:
    """The canonical surrogate in the format of the text's spelling."""
    if kind in ("card", "ssn", "phone", "iban"):
        dialled = sum(c.isalnum() for c in surface) - len(value)  # a country code that the value leaves out
        left = iter([c for c in surface if c.isalnum()][:dialled] + list(value))
        return "".join(next(left) if c.isalnum() else c for c in surface)
    if kind == "email":
        return value.upper() if surface.isupper() else value
    if kind == "name":
        return value.upper() if surface.isupper() else value.title()
    return value


def _entities(texts: DataFrame) -> DataFrame:
    """(text_key, kind, value, gender) of every entity of every text."""
    def run(batches):
        for batch in small_batches(batches):
            rows = [(key, *entity) for key, text in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), strict=True)
                    for entity in dict.fromkeys(x[2:] for x in find(text))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["text_key", "kind", "value", "gender"])

    return arrow_map(texts, run, "text_key string, kind string, value string, gender string")


def _drawn(entities: DataFrame, attempt: int, key: bytes) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("kind", "value", "gender")], strict=True)
            made = pa.array([surrogate(*r, attempt, key) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("kind", "value", "gender")], made], names=["kind", "value", "gender", "surrogate"])

    return arrow_map(entities.select("kind", "value", "gender"), run, "kind string, value string, gender string, surrogate string")


def assign(entities: DataFrame, key: bytes = KEY, draw=_drawn) -> DataFrame:
    """(kind, value, surrogate), one to one inside a kind, and no surrogate an entity of the kind."""
    open_, done, attempt = entities, None, 0
    taken = real = entities.select("kind", F.col("value").alias("surrogate"))
    while True:
        drawn = staged(draw(open_, attempt, key), "drawn")
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        done = first if done is None else done.unionByName(first)
        done = staged(done, "assigned")
        open_ = staged(drawn.join(first.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "gender"), "open")
        if open_.isEmpty():
            return done.select("kind", "value", "surrogate")
        taken, attempt = real.unionByName(done.select("kind", "surrogate")), attempt + 1
        if attempt == ROUNDS:
            raise RuntimeError(f"no free surrogates after {ROUNDS} rounds: {open_.select('kind').distinct().limit(9).collect()}")


def _replaced(found: DataFrame) -> DataFrame:
    """(text, doc, n): ``found`` (text, doc, given) with surrogates in the text and their number."""
    doc = found.schema["doc"]
    schema = T.StructType([T.StructField("text", T.StringType()), doc, T.StructField("n", T.LongType(), False)])

    def run(batches):
        for batch in small_batches(batches):
            out, counts = [], []
            for text, given in zip(batch.column("text").to_pylist(), batch.column("given").to_pylist(), strict=True):
                table = {(g["kind"], g["value"]): g["surrogate"] for g in given or []}
                end, parts, entities = 0, [], find(text)
                for start, stop, kind, value, _ in entities:
                    parts += [text[end:start], render(kind, text[start:stop], table[kind, value])]
                    end = stop
                out.append("".join([*parts, text[end:]]))
                counts.append(len(entities))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column("doc"), pa.array(counts, pa.int64())], names=["text", "doc", "n"])

    return arrow_map(found.select("text", "doc", "given"), run, schema)


def pseudonymize(docs: DataFrame, key: bytes = KEY, counted: str | None = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the number of replacements in it as ``counted`` (None: no such column).

    Of the input's columns one named ``counted`` is replaced, and ``n_chars`` follows a changed text; all others stay as they are.
    """
    if counted is not None and counted in docs.columns:
        docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != counted])
    own = packed(docs)
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    held = own.where(has).withColumn("text_key", F.md5("text"))
    found = staged(_entities(held.select("text_key", "text")), "entities")
    table = assign(staged(found.groupBy("kind", "value").agg(F.max("gender").alias("gender")), "distinct-entities"), key)
    given = (found.select("text_key", "kind", "value").distinct().join(table, ["kind", "value"])
             .groupBy("text_key").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("given")))
    whole = _replaced(held.join(given, "text_key", "left")).unionByName(own.where(~has).withColumn("n", F.lit(0).cast("long")))
    changed = {}
    if "n_chars" in docs.columns:
        was = F.col("doc").getField(f"c{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(F.col("n") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(was)
    return whole.select(*unpacked(docs, **changed), *([] if counted is None else [F.col("n").alias(counted)]))
