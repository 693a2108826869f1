"""Personal data replaced by surrogates of the same type, format, script and gender.

Detected entities are mapped by keyed permutations over their own format class:
digits to digits, hex to hex, vowels to vowels and consonants to consonants of
the same script and case, listed first names to first names of the same gender
and script, card numbers to card numbers with the same checksum validity,
addresses to addresses of the same range.  One key gives one surrogate to one
entity wherever it occurs (coreference), and permutations keep distinct
entities distinct.

The collision check runs over all distinct entities of the corpus: a surrogate
that is itself an entity of the corpus (or the entity it stands for) is drawn
again under another tweak, until it is new and no other entity's; those few
decisions are joined back.  A value whose format has no free member left (REDRAWS
rounds without a new one) becomes ``[type-number]``, which is not of its type.

The key is no part of this package: it is the Spark setting KEY_SETTING, else
32 random bytes drawn once per application.  Surrogates are the same in every run
with one key, and without the key they can't be turned back.

Names are found after a title or a cue ("my name is", "regards,") or if they
begin with a listed first name; other names are not told from other words.

Defined results: null text stays null; a text without entities is unchanged;
repeated rows are treated alike; all columns of the input pass through.  Every
search takes time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StringType, StructField, StructType

from .support import free_name, scratch_scope, stage

KEY_SETTING = "spark.tessera.pii.key"
REDRAWS = 64
_drawn: dict[str, bytes] = {}
#: Up to this many redrawn surrogates travel with the tasks; beyond, they are joined.
BROADCAST_FIXES = 10_000

#: First names by script and gender (fixed values).
NAMES = {
    ("latin", "f"): "Anna Maria Laura Julia Emma Sophie Clara Elena Alice Nina Sarah Marie Lucia Carmen Isabel Ingrid Helga Petra Claire Camille Mary Patricia Jennifer Linda Susan".split(),
    ("latin", "m"): "Peter Paul Thomas Daniel David Martin Lukas Felix Simon Oscar Hugo Jean Pierre Louis Carlos Miguel Diego Pablo Hans Karl James Robert John Michael William".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил".split(),
}
#: Titles and their gender (fixed values).
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Herr": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Господин": "m", "Госпожа": "f",
}
_GENDER = {n: g for (_, g), names in NAMES.items() for n in names}
_POOL = {n: names for names in NAMES.values() for n in names}

#: Letter classes that are permuted among themselves (fixed values).
CLASSES = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñß",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
)
_CLASS_OF = {}
for _k, _letters in enumerate(CLASSES):
    for _i, _c in enumerate(_letters):
        _CLASS_OF[_c] = (_k, _i, False)
    for _i, _c in enumerate(_letters.upper() if len(_letters.upper()) == len(_letters) else ""):
        _CLASS_OF.setdefault(_c, (_k, _i, True))

#: A run of address characters before "@", entered at its beginning only, and the host's labels.
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+\-])([A-Za-z0-9._%+\-]*+)@([A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*+)")
_TOP = re.compile(r"[A-Za-z]{2,}+")
_NUMBERS = re.compile(
    r"(?P<secret>(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-]))"
    r"|(?P<card>(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{8,14}(?!\d))"
)
_SECRET = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_\-]?key|access[_\-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_\-+/=]{12,})")
_NAME = re.compile(
    r"(?<!\w)(?P<title>%s)\.? (?P<name>[^\W\d_a-zа-я][^\W\d_]+(?: [^\W\d_a-zа-я][^\W\d_]+){0,2})" % "|".join(sorted(TITLES, key=len, reverse=True))
)
_CUE = re.compile(
    r"(?<!\w)(?:[Mm]y name is|[Nn]ame:|[Ss]igned by|[Ss]igned,|[Rr]egards,|[Ss]incerely,|[Dd]ear) (?P<name>[^\W\d_a-zа-я][^\W\d_]+(?: [^\W\d_a-zа-я][^\W\d_]+){1,2})"
)
_LISTED = re.compile(r"(?<!\w)(?P<name>(?:%s) [^\W\d_a-zа-я][^\W\d_]+)" % "|".join(_GENDER))
_DIGIT = re.compile(r"\d")
_TITLED = re.compile("|".join(f"{t}\\b" for t in TITLES))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    """Spans of addresses: the host ends with its last label that begins with two letters."""
    for m in _EMAIL.finditer(text):
        if not m[1] or not m[1][-1].isalnum():
            continue
        end = m.end()
        labels = m[2].split(".")
        for label in reversed(labels[1:]):
            top = _TOP.match(label)
            if top:
                yield m.start(), end - len(label) + top.end(), "email"
                break
            end -= len(label) + 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of entities, without overlaps, in order."""
    spans: list[tuple[int, int, str]] = []
    if "@" in text:
        spans += _emails(text)
    if "=" in text or ":" in text:
        spans += [(*m.span(1), "secret") for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):
        spans += [(*m.span(), m.lastgroup) for m in _NUMBERS.finditer(text)]
    for m in _NAME.finditer(text) if _TITLED.search(text) else ():
        spans.append((*m.span("name"), "name_" + TITLES[m["title"]]))
    for m in _LISTED.finditer(text):
        spans.append((*m.span("name"), "name_" + _GENDER[m["name"].split(" ")[0]]))
    for m in _CUE.finditer(text):
        if m["name"].split(" ")[0] not in TITLES:
            spans.append((*m.span("name"), "name_" + _GENDER.get(m["name"].split(" ")[0], "u")))
    out, end = [], 0
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= end:
            out.append((s, e, kind))
            end = e
    return out


# -- keyed permutations -----------------------------------------------------


def session_key(spark: SparkSession) -> bytes:
    """The key of this application: configured, or drawn once."""
    own = spark.conf.get(KEY_SETTING, None)
    if own:
        return own.encode()
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key
        self._memo: dict[tuple, str] = {}

    def _number(self, *parts) -> int:
        return int.from_bytes(hmac.new(self.key, "\0".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")

    def permute(self, values: list[int], radix: list[int], tweak: str) -> list[int]:
        """A keyed permutation of the vectors with these radices (a Feistel network)."""
        n = len(values)
        if not n:
            return values
        if n == 1:
            order = sorted(range(radix[0]), key=lambda i: self._number(tweak, "one", radix[0], i))
            return [order[values[0]]]
        half = n // 2
        a, b = values[:half], values[half:]
        ra, rb = radix[:half], radix[half:]
        for r in range(8):
            # the moving half is shifted by a function of the other; halves keep their places
            if r % 2:
                b = self._shift(b, rb, self._number(tweak, r, a))
            else:
                a = self._shift(a, ra, self._number(tweak, r, b))
        return a + b

    @staticmethod
    def _shift(v: list[int], radix: list[int], by: int) -> list[int]:
        out = []
        for x, m in zip(v, radix, strict=True):
            out.append((x + by) % m)
            by //= m
        return out

    def word(self, text: str, tweak: str, fixed: int = 0) -> str:
        """Digits and letters permuted in their classes; case, script and the rest kept.

        ``fixed`` characters at the end stay, to keep a gendered ending.
        """
        head, tail = (text[:-fixed], text[-fixed:]) if fixed and len(text) > fixed else (text, "")
        slots, values, radix, shape = [], [], [], []
        for i, c in enumerate(head):
            if c.isdigit() and c.isascii():
                slots.append((i, "0123456789", False))
                values.append(int(c))
                radix.append(10)
                shape.append("d")
            elif c in _CLASS_OF:
                k, at, upper = _CLASS_OF[c]
                slots.append((i, CLASSES[k], upper))
                values.append(at)
                radix.append(len(CLASSES[k]))
                shape.append(f"{k}{'U' if upper else 'l'}")
            else:
                shape.append(c)
        out = list(head)
        form = f"{tweak}|{'.'.join(shape)}|{tail}"
        for (i, letters, upper), v in zip(slots, self.permute(values, radix, form), strict=True):
            out[i] = letters[v].upper() if upper else letters[v]
        return "".join(out) + tail

    def _digits(self, text: str, keep: int, tweak: str, accept=None) -> str:
        """The digits of ``text`` permuted after the first ``keep``."""
        own = [i for i, c in enumerate(text) if c.isdigit()]
        form = f"{tweak}|{re.sub('[0-9]', '0', text)}|{''.join(text[i] for i in own[:keep])}"
        values = [int(text[i]) for i in own[keep:]]
        while True:
            values = self.permute(values, [10] * len(values), form)
            out = list(text)
            for i, v in zip(own[keep:], values, strict=True):
                out[i] = str(v)
            done = "".join(out)
            if accept is None or accept(done):
                return done

    def _hex(self, text: str, tweak: str) -> str:
        case = [c.isupper() for c in text]
        v = self.permute([int(c, 16) for c in text], [16] * len(text), f"{tweak}|{len(text)}")
        # letters keep the case of the whole; digits have none
        upper = any(case)
        return "".join(f"{x:X}" if upper else f"{x:x}" for x in v)

    def _ip(self, text: str, tweak: str) -> str:
        def kind(q: list[int]) -> str:
            if q[0] == 10 or q[0] == 127 or q[:2] == [192, 168] or (q[0] == 172 and 16 <= q[1] < 32):
                return f"private {q[0]}"
            return "multicast" if q[0] >= 224 else "none" if q[0] == 0 else "public"

        start = q = [int(x) for x in text.split(".")]
        while True:
            q = self.permute(q, [256] * 4, tweak)
            if kind(q) == kind(start):
                return ".".join(map(str, q))

    def _iban(self, text: str, tweak: str) -> str:
        body = text[4:].replace(" ", "")
        new = self.word(body, f"{tweak}|{text[:2]}")
        new = "".join(n if n.isascii() else o for n, o in zip(new, body, strict=True))
        check = 98 - int("".join(str(int(c, 36)) for c in new + text[:2] + "00")) % 97
        it = iter(new)
        return f"{text[:2]}{check:02d}" + "".join(" " if c == " " else next(it) for c in text[4:])

    def _name(self, text: str, gender: str, tweak: str) -> str:
        out = []
        for i, part in enumerate(text.split(" ")):
            pool = _POOL.get(part)
            if pool and i == 0:
                order = sorted(range(len(pool)), key=lambda k: self._number(tweak, "pool", gender, pool[0], k))
                out.append(pool[order[pool.index(part)]])
            else:
                out.append(self.word(part, f"{tweak}|{gender}", 1))
        return " ".join(out)

    def _email(self, text: str, tweak: str) -> str:
        local, _, host = text.partition("@")
        labels = host.split(".")
        keep = 2 if len(labels) > 1 and labels[-2] == "example" else 1
        front = ".".join(labels[:-keep])
        return self.word(local, f"{tweak}|local|{host.count('.')}") + "@" + ".".join(([self.word(front, f"{tweak}|host")] if front else []) + labels[-keep:])

    def of(self, kind: str, value: str, attempt: int = 0) -> str:
        """The surrogate of an entity; other attempts are other permutations."""
        at = (kind, value, attempt)
        if at not in self._memo:
            if len(self._memo) > 50_000:
                self._memo.clear()
            self._memo[at] = self._draw(kind, value, f"{kind}#{attempt}")
        return self._memo[at]

    def _draw(self, kind: str, value: str, tweak: str) -> str:
        if kind == "email":
            return self._email(value, tweak)
        if kind == "ip":
            return self._ip(value, tweak)
        if kind == "card":
            valid = luhn(re.sub(r"\D", "", value))
            return self._digits(value, 1, tweak, lambda x: luhn(re.sub(r"\D", "", x)) == valid)
        if kind == "phone":
            country = len(m[1]) if (m := re.match(r"\+(\d{1,3})[ .\-(]", value)) else int(value[0] == "+")
            return self._digits(value, country, tweak)
        if kind == "ssn":
            return self._digits(value, 0, tweak)
        if kind == "iban":
            return self._iban(value, tweak)
        if kind == "secret":
            pure = re.fullmatch("[0-9a-f]+|[0-9A-F]+", value)
            return self._hex(value, tweak) if pure and re.search("[a-fA-F]", value) else self.word(value, tweak)
        return self._name(value, kind[-1], tweak)


# -- Spark ------------------------------------------------------------------


def _entities(key: bytes):
    def run(batches):
        own = Surrogates(key)
        for batch in batches:
            seen = {}
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s, e, kind in find(text) if text else ():
                    seen[k, kind, text[s:e]] = None
            if seen:
                k, kind, value = zip(*seen, strict=True)
                made = [own.of(a, b) for a, b in zip(kind, value, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(kind), pa.array(value), pa.array(made)], ["text_key", "kind", "value", "surrogate"]
                )

    return run


def _redraw(key: bytes, attempt: int):
    def run(batches):
        own = Surrogates(key)
        for batch in batches:
            made = [own.of(a, b, attempt) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["kind", "value", "surrogate"])

    return run


def redrawn(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) of entities whose first surrogate collides."""
    known = stage(entities.select("kind", "value", "surrogate").distinct(), "entities")
    values = known.select(F.col("value").alias("taken")).distinct()
    first = known.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("owner"), F.countDistinct("value").alias("n"))
    clash = known.join(values, F.col("surrogate") == F.col("taken"), "left_semi").union(
        known.join(first.where("n > 1"), "surrogate").where(F.col("value") != F.col("owner.value")).select("kind", "value", "surrogate")
    )
    open_ = stage(clash.select("kind", "value").distinct(), "open")
    settled, attempt = [], 0
    while open_.limit(1).count():
        attempt += 1
        drawn = open_.mapInArrow(_redraw(key, attempt), "kind string, value string, surrogate string")
        drawn = drawn.join(values, F.col("surrogate") == F.col("taken"), "left_anti")
        drawn = drawn.join(known.select("surrogate"), "surrogate", "left_anti").select("kind", "value", "surrogate")
        for x in settled:
            drawn = drawn.join(x.select("surrogate"), "surrogate", "left_anti").select("kind", "value", "surrogate")
        one = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("w"))
        good = stage(one.select("w.kind", "w.value", "surrogate"), "settled")
        settled.append(good)
        left = stage(open_.join(good, ["kind", "value"], "left_anti"), "open")
        if attempt >= REDRAWS and left.count() == open_.count():
            # fewer members than entities, so none is free
            settled.append(left.withColumn("surrogate", F.concat(F.lit("["), "kind", F.lit("-"), F.hex(F.xxhash64("value")), F.lit("]"))))
            break
        open_ = left
    out = settled[0] if settled else known.where("false")
    for x in settled[1:]:
        out = out.unionByName(x)
    return out


def _replace(key: bytes, fixes: dict[tuple[str, str], str], joined: bool, at: int, names: list[str]):
    """Texts with surrogates and numbers of entities; if ``joined``, the last column has the row's fixes."""

    def run(batches):
        own = Surrogates(key)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            fixed = [dict((tuple(k.split("\0", 1)), v) for k, v in x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()] if joined else None
            out, count = [], []
            for r, text in enumerate(texts):
                found = find(text) if text else []
                if found:
                    mine = fixed[r] if joined else fixes
                    parts, end = [], 0
                    for s, e, kind in found:
                        value = text[s:e]
                        parts += [text[end:s], mine.get((kind, value)) or own.of(kind, value)]
                        end = e
                    text = "".join(parts) + text[end:]
                out.append(text)
                count.append(len(found))
            cols = batch.columns[: batch.num_columns - joined]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array(count, pa.int64())], names)

    return run


def pseudonymise(docs: DataFrame, text: str = "text", key: bytes | None = None, count: str | None = None, broadcast_fixes: int = BROADCAST_FIXES) -> DataFrame:
    """``docs`` with entities in ``text`` replaced; ``count`` names an optional column."""
    key = key or session_key(docs.sparkSession)
    own = F.col(f"`{text}`")
    text_key = F.xxhash64(own, F.length(own))
    with scratch_scope(docs.sparkSession) as scratch:
        found = stage(
            docs.where(own.isNotNull())
            .select(text_key.alias("text_key"), own.alias("text"))
            .mapInArrow(_entities(key), "text_key bigint, kind string, value string, surrogate string"),
            "found",
        )
        fixes = stage(redrawn(found, key), "fixes")
        made, n, known, at_key = (free_name([*docs.columns, count or ""], x) for x in ("made", "n_found", "fixes", "text_key"))
        schema = StructType([*docs.schema.fields, StructField(made, StringType()), StructField(n, LongType())])
        at, names = docs.columns.index(text), [*docs.columns, made, n]
        few = fixes.limit(broadcast_fixes + 1).count() <= broadcast_fixes
        if few:
            small = {(r["kind"], r["value"]): r["surrogate"] for r in fixes.collect()}
            done = docs.mapInArrow(_replace(key, small, False, at, names), schema)
        else:
            # one row per text that needs a fix, however often the text occurs; null texts take no part
            mine = (
                found.select("text_key", "kind", "value")
                .distinct()
                .join(fixes, ["kind", "value"])
                .groupBy("text_key")
                .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\0", "kind", "value"), "surrogate"))).alias(known))
                .withColumnRenamed("text_key", at_key)
            )
            keyed = docs.where(own.isNotNull()).join(mine, text_key == F.col(at_key), "left").drop(at_key)
            rest = docs.where(own.isNull()).withColumn(known, F.lit(None).cast("map<string,string>"))
            done = keyed.unionByName(rest).mapInArrow(_replace(key, {}, True, at, names), schema)
        scratch.release(done)
    out = [F.col(made).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*out, *([F.col(n).alias(count)] if count else []))
