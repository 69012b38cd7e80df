"""Surrogates for private data.

Detected entities get keyed replacements of the same type and format. Digits,
hexadecimal digits and letters go through a keyed permutation of all strings
of one format, so different entities of a format stay different and one entity
is the same surrogate everywhere, without any table. A person's given and
family name are entities of their own, so that full, short and titled forms
agree; both become syllables of their script, the given name with an ending of
its gender. A check over the whole corpus then finds surrogates that two
entities share or that are real entities themselves, and draws those again.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import written
from .rows import unwrapped, wrapped
from .words import sliced

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Lower-case and capital letters of Latin-1 beyond ASCII.
LOWER_MORE, UPPER_MORE = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Forms of address by gender.
ADDRESS = {
    "f": ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra.", "г-жа"),
    "m": ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "г-н"),
    "x": ("Dr.", "Dr", "Prof.", "Prof"),
}
#: Frequent given names by gender; one before a capitalised word is a person without a form of address.
GIVEN = {
    "f": """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley
    Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy
    Jane Anna Maria Ursula Monika Petra Sabine Renate Claudia Birgit Ingrid Erika Brigitte Heike Nathalie Isabelle
    Sylvie Catherine Martine Françoise Carmen Josefa Isabel Dolores Pilar Ольга Елена Наталья Татьяна Ирина Светлана""".split(),
    "m": """James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven
    Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan
    Stephen Peter Wolfgang Klaus Jürgen Dieter Manfred Helmut Hans Günter Heinz Werner Philippe Alain Bernard Thierry
    Antonio José Manuel Francisco Carlos Александр Сергей Дмитрий Алексей Андрей Иван""".split(),
}
GENDER = {name: g for g, names in GIVEN.items() for name in names}
#: Consonants and vowels of the syllables, and the endings of given names by gender.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу")}
ENDINGS = {"latin": {"f": "a", "m": "o", "x": "i"}, "cyrillic": {"f": "а", "m": "", "x": "о"}}
ADDRESSED = {a: g for g, names in ADDRESS.items() for a in names}
_TITLES = "|".join(re.escape(a) for a in sorted(ADDRESSED, key=len, reverse=True))
_GIVEN = "|".join(sorted(GENDER, key=len, reverse=True))
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_NAME = r"[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-яё]+(?:[-'’][A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-яё]+)?"
_MIDDLE = r"(?:[A-ZА-Я]\. )?"
#: National phone numbers: ddd-ddd-dddd with dashes, dots or spaces, and 9 to 12 grouped digits from 0.
_ENDS = r"(?![\w/]|[.-]?[0-9])"
_TEN = [rf"(?:1{s})?{a}{s}[0-9]{{3}}{s}[0-9]{{4}}" for s, a in (("-", "[0-9]{3}"), (r"\.", "[0-9]{3}"), (" ", "[2-9][0-9]{2}"))]
_ZERO = [
    rf"(?=0(?:{s}?[0-9]){{8,11}}(?!{s}?[0-9]))(?!{SSN})0[1-9][0-9]{{0,4}}(?:{s}[0-9]{{2,8}}){{1,4}}" for s in ("-", r"\.", " ")
]
_AREA = [r"\(0[1-9][0-9]{0,4}\) ?[0-9]{3,5}[ -]?[0-9]{3,5}", r"0[1-9][0-9]{1,4} ?/ ?[0-9]{3,5}[ -]?[0-9]{2,5}"]
_NATIONAL = rf"(?<![\w.+/-])(?:{'|'.join(_TEN + _ZERO + _AREA)}){_ENDS}|(?<!\w)\([0-9]{{3}}\) ?[0-9]{{3}}[. -][0-9]{{4}}{_ENDS}"
_H = "[0-9A-Fa-f]{1,4}"
#: Kind and pattern, tried in this order at each place.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9À-ÿ][\w.+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\b\s*[:=]\s*[\"']?)"
    r"(?:[A-Za-z0-9+/_-]{8,}|(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{6,7}(?![A-Za-z0-9+/_-]))",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip6": rf"(?<![\w:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}(?::{_H}){{0,6}})?::(?:{_H}(?::{_H}){{0,6}})?)(?![\w:])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}\b|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b|" + _NATIONAL,
    "ssn": SSN,
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?!\.?[0-9])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9-])"
    r"|(?<![0-9-])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9-])",
    "name": rf"(?<!\w)(?:{_TITLES}) (?:{_NAME} {_MIDDLE})?{_NAME}|(?<!\w)(?:{_GIVEN}) {_MIDDLE}{_NAME}",
}
FIND = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
#: Every entity holds a digit, an @ or two colons, a form of address or a given name; other lines are not searched.
SIGN = re.compile("[0-9@]|::")
TITLES = tuple(a + " " for a in ADDRESSED)
NAMED = re.compile(rf"(?<!\w)(?:{_GIVEN}) [A-ZÀ-ÖØ-ÞА-Я]")
TITLED = re.compile(rf"(?:(?P<title>{_TITLES}) )?(?:(?P<given>{_NAME}) (?P<middle>{_MIDDLE}))?(?P<family>{_NAME})")
SECRET = re.compile(r"^(.*?[:=]\s*[\"']?)(.*)$", re.S)
ROUNDS = 8
#: With so many redrawn entities or fewer they are sent to every worker; with more they are joined.
SENT_TO_ALL = 100_000


def _permuted(symbols: list[int], radix: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of all symbol strings of these radices: an unbalanced Feistel network over two halves."""
    if not symbols:
        return symbols
    half = len(symbols) // 2
    parts = [(list(symbols[:half]), radix[:half]), (list(symbols[half:]), radix[half:])]
    for r in range(ROUNDS):
        (left, base), (right, _) = parts[r % 2], parts[1 - r % 2]
        said = f"{tweak}|{r}|{','.join(map(str, right))}".encode()
        for i in range(len(left)):
            if i % 16 == 0:
                drawn = hashlib.blake2b(said + b"|%d" % i, key=key, digest_size=64).digest()
            at = 4 * (i % 16)
            left[i] = (left[i] + int.from_bytes(drawn[at : at + 4], "big")) % base[i]
    return parts[0][0] + parts[1][0]


def _classes(text: str, hexadecimal: bool = False) -> list[str | None]:
    """The alphabet of each character, None where it stays."""
    if hexadecimal:
        return [HEX if c in HEX else None for c in text]
    return [next((a for a in (DIGITS, LOWER, UPPER, LOWER_MORE, UPPER_MORE) if c in a), None) for c in text]


def _same_format(text: str, key: bytes, tweak: str, classes: list[str | None]) -> str:
    at = [i for i, a in enumerate(classes) if a]
    out = list(text)
    radix = [len(classes[i]) for i in at]
    shape = ",".join(map(str, radix))
    moved = _permuted([classes[i].index(text[i]) for i in at], radix, key, f"{tweak}|{shape}")
    for i, s in zip(at, moved):
        out[i] = classes[i][s]
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _remainder(iban: str) -> int:
    """The number of an account number with letters as 10 to 35 and its head at the end, modulo 97; 1 where it is right."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _private(m: re.Match) -> bool:
    """False for what only looks like an entity.

    Plain runs of 13 digits that no issuer gives out, such as times and
    article numbers: 4 and Luhn; account numbers with wrong check digits; and
    colons that make no address.
    """
    found = m[0]
    if m.lastgroup == "iban":
        return 15 <= len(found.replace(" ", "")) <= 34 and _remainder(found.replace(" ", "")) == 1
    if m.lastgroup == "ip6":
        try:
            return len(ipaddress.IPv6Address(found).compressed) > 4 and found.count(":") > 2
        except ValueError:
            return False
    return m.lastgroup != "card" or len(found) != 13 or not found.isdigit() or (found[0] == "4" and not _luhn(found))


def _may_hold(text: str) -> bool:
    return SIGN.search(text) is not None or any(t in text for t in TITLES) or NAMED.search(text) is not None


class Mention(NamedTuple):
    """A place in a text, and the normal form of the entity that stands there."""

    start: int
    end: int
    kind: str
    found: str
    entity: str


def _script(name: str) -> str:
    return "cyrillic" if re.search("[А-я]", name) else "latin"


@lru_cache(1024)
def _bare(families: frozenset[str]) -> re.Pattern:
    names = "|".join(re.escape(f) for f in sorted(families, key=lambda f: (-len(f), f)))
    return re.compile(rf"(?<![\w@.-])(?:(?P<given>{_NAME}) (?P<middle>{_MIDDLE}))?(?P<family>{names})(?![\w@]|-[A-Za-z])")


def mentions(text: str | None) -> list[Mention]:
    """The entities of a text in their order; none reaches across a line end.

    A family name that a person has somewhere in the text is found again on
    its own or behind a given name. A given name has the gender that any form
    of address in the text gives it, else that of the list.
    """
    if not text or not _may_hold(text):
        return []
    plain, names, at = [], [], 0
    for line in text.split("\n"):
        if _may_hold(line):
            for m in FIND.finditer(line):
                if m.lastgroup == "name":
                    names.append((at + m.start(), TITLED.fullmatch(m[0])))
                elif _private(m):
                    plain.append(Mention(at + m.start(), at + m.end(), m.lastgroup, m[0], normal(m.lastgroup, m[0])))
        at += len(line) + 1
    if not names:
        return plain
    gender: dict[str, str] = {}
    for _, m in names:
        if m["given"]:
            known = ADDRESSED.get(m["title"], "x")
            known = GENDER.get(m["given"], "x") if known == "x" else known
            if gender.get(m["given"], "x") == "x":
                gender[m["given"]] = known
    spans = sorted([(x.start, x.end) for x in plain] + [(s, s + m.end()) for s, m in names])
    families, again, k = frozenset(m["family"] for _, m in names if len(m["family"]) > 2), [], 0
    if families:
        for m in _bare(families).finditer(text):
            while k < len(spans) and spans[k][1] <= m.start("family"):
                k += 1
            if k == len(spans) or spans[k][0] >= m.end():
                again.append((m, m["given"] if m["given"] and (m["given"] in gender or m["given"] in GENDER) else None))

    def parts(m: re.Match, start: int, given: str | None) -> Iterator[Mention]:
        if given:
            g = gender.get(given) or GENDER[given]
            yield Mention(start + m.start("given"), start + m.end("given"), "given", given, f"{g}|{_script(given)}|{given}")
        f = m["family"]
        yield Mention(start + m.start("family"), start + m.end("family"), "family", f, f"{_script(f)}|{f}")

    out = plain + [x for s, m in names for x in parts(m, s, m["given"])] + [x for m, g in again for x in parts(m, 0, g)]
    return sorted(out)


def normal(kind: str, found: str) -> str:
    """What two mentions of one entity have in common."""
    if kind in ("email", "ip6"):
        return found.lower()
    if kind in ("phone", "card", "ssn"):
        digits = re.sub("[^0-9]", "", found)
        if kind == "phone" and not found.startswith("+"):  # a national number of North America, with its country code
            if len(digits) == 10 and digits[0] != "0":
                return "+1" + digits
            if len(digits) == 11 and digits[0] == "1":
                return "+" + digits
        return ("+" if found.startswith("+") else "") + digits
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "secret":
        return SECRET.match(found)[2]
    return found


def _drawn_name(entity: str, key: bytes, tweak: str, syllables: int) -> str:
    """Syllables of the entity's script, with the ending of its gender if it has one."""
    *gender, script, _ = entity.split("|")
    h = int.from_bytes(hashlib.blake2b(f"{tweak}|{entity}".encode(), key=key, digest_size=32).digest(), "big")
    consonants, vowels = SYLLABLES[script]
    name = ""
    for _ in range(syllables):
        h, c = divmod(h, len(consonants))
        h, v = divmod(h, len(vowels))
        name += consonants[c] + vowels[v]
    if gender:
        name += consonants[h % len(consonants)] + ENDINGS[script][gender[0]]
    return name.capitalize()


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a normal form, itself a normal form of the kind."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        fixed = 2 if labels[-2:-1] == ["example"] else 1
        move = lambda s, what: _same_format(s, key, f"{tweak}|{what}", _classes(s))
        return move(local, "local") + "@" + ".".join([*(move(x, "domain") for x in labels[:-fixed]), *labels[-fixed:]])
    if kind == "phone":
        plus, digits = entity[: entity.startswith("+")], entity[entity.startswith("+") :]
        keep = 1 if digits.startswith("1") and (plus or len(digits) == 11) else 0 if not plus else 2
        classes = [None] * keep + [DIGITS] * (len(digits) - keep)
        if not plus and digits.startswith("0"):  # as does the 0 before an area, which is not 0 again
            classes[:2] = [None, DIGITS[1:] if digits[1] != "0" else None]
        if len(digits) - keep == 10:  # area codes start from 2; the exchange for fiction stays
            if digits[keep] != "0" or plus:
                classes[keep] = DIGITS[2:] if digits[keep] in DIGITS[2:] else None
            if digits[keep + 3 : keep + 6] == "555":
                classes[keep + 3 : keep + 6] = [None] * 3
        return plus + _same_format(digits, key, tweak, classes)
    if kind == "ip":
        return ".".join(map(str, _permuted([int(x) for x in entity.split(".")], [256] * 4, key, tweak)))
    if kind == "card":
        body = _same_format(entity[:-1], key, tweak, [None] + [DIGITS] * (len(entity) - 2))  # the issuer's digit stays
        return body + str((int(entity[-1]) + _luhn(entity[:-1] + "0") - _luhn(body + "0")) % 10)
    if kind == "key":
        body = entity[4:]
        drawn = _permuted([(DIGITS + UPPER).index(c) for c in body], [36] * len(body), key, tweak)
        return entity[:4] + "".join((DIGITS + UPPER)[i] for i in drawn)
    if kind in ("given", "family"):  # longer ones where short ones run out
        return entity.rpartition("|")[0] + "|" + _drawn_name(entity, key, tweak, (2 if kind == "given" else 4) + attempt // 2)
    if kind == "iban":
        body = _same_format(entity[4:], key, tweak, _classes(entity[4:]))
        return entity[:2] + f"{98 - _remainder(entity[:2] + '00' + body):02}" + body
    if kind == "ip6":
        return _same_format(entity, key, tweak, _classes(entity, True))
    return _same_format(entity, key, tweak, _classes(entity, all(c in HEX for c in entity)))


def shown(kind: str, found: str, new: str) -> str:
    """The surrogate in the dress of the mention: its separators and its case."""
    if kind == "email":
        return "".join(y.upper() if x.isupper() and len(y.upper()) == 1 else y for x, y in zip(found, new))
    if kind == "ip6":
        return new.upper() if found == found.upper() else new
    if kind in ("phone", "card", "ssn"):
        n = sum(c in DIGITS for c in found)
        digits = iter(new.lstrip("+")[-n:])
        return "".join(next(digits) if c in DIGITS else c for c in found)
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in found)
    if kind == "secret":
        return SECRET.match(found)[1] + new
    return new.rpartition("|")[2] if kind in ("given", "family") else new


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity) of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for part in sliced(batch, "text"):
                for t in part.column("text").to_pylist():
                    seen.update((m.kind, m.entity) for m in mentions(t))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*seen)], ["kind", "entity"])

    return docs.select("text").mapInArrow(run, "kind string, entity string").distinct()


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            new = [surrogate(k, e, key, a) for k, e, a in zip(pdf["kind"], pdf["entity"], pdf["attempt"])]
            yield pdf.assign(surrogate=new)

    return rows.select("kind", "entity", "attempt").mapInPandas(
        run, "kind string, entity string, attempt int, surrogate string"
    )


def redrawn(found: DataFrame, key: bytes, rounds: int = 50) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate collides.

    A surrogate must differ from every real entity and every other surrogate
    of its kind; of several that share one the smallest entity keeps it. All
    checks are joins and aggregates over the entity table.
    """
    now = written(_drawn(found.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = found.select("kind", F.col("entity").alias("surrogate"))
    for _ in range(rounds):
        owner = now.groupBy("kind", "surrogate").agg(F.min("entity").alias("_owner"))
        marked = now.join(owner, ["kind", "surrogate"]).join(
            real.withColumn("_real", F.lit(True)), ["kind", "surrogate"], "left"
        )
        bad = F.coalesce("_real", F.lit(False)) | (F.col("entity") != F.col("_owner"))
        marked = written(marked.withColumn("_bad", bad), "surrogates")
        if marked.filter("_bad").isEmpty():
            return now.filter("attempt > 0").select("kind", "entity", "attempt")
        again = marked.filter("_bad").withColumn("attempt", F.col("attempt") + 1)
        good = marked.filter("not _bad").select("kind", "entity", "attempt", "surrogate")
        now = written(good.unionByName(_drawn(again, key)), "surrogates")
    raise RuntimeError("surrogates still collide; the formats leave too few of them")


def replace(docs: DataFrame, key: bytes, sent_to_all: int = SENT_TO_ALL) -> DataFrame:
    """Replace the entities in ``text`` and add n_entities.

    A NULL text stays NULL and has none. Rows do not depend on each other but
    through the collision check; repeated rows come out alike, NULL ids take
    part, an empty table gives no rows. A long text is searched whole, line by
    line. A column called n_entities is replaced; all others stay, whatever
    their names.
    """
    base = wrapped(docs, "text", without=("n_entities",))
    again = written(redrawn(written(entities(base), "entities"), key), "redrawn")
    if again.count() <= sent_to_all:
        done = _applied(base, key, {(r["kind"], r["entity"]): r["attempt"] for r in again.collect()})
    else:
        done = _joined(base, key, again)
    return done.select(*unwrapped([c for c in docs.columns if c.lower() != "n_entities"], "text"), "n_entities")


def _rewrite(text: str | None, key: bytes, attempts: dict) -> tuple[str | None, int]:
    found = mentions(text)
    if not found:
        return text, 0
    out, at = [], 0
    for m in found:
        out += [text[at : m.start], shown(m.kind, m.found, surrogate(m.kind, m.entity, key, attempts.get((m.kind, m.entity), 0)))]
        at = m.end
    return "".join([*out, text[at:]]), len(found)


def _applied(rows: DataFrame, key: bytes, table: dict) -> DataFrame:
    """Rewrite ``text`` of (text, row[, again]); redrawn entities stand in ``table`` or beside the row in ``again``."""
    fields = [f for f in rows.schema.fields if f.name != "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                texts = part.column("text").to_pylist()
                own = part.column("again").to_pylist() if "again" in part.schema.names else [None] * len(texts)
                out = [_rewrite(t, key, {(x["kind"], x["entity"]): x["attempt"] for x in o} if o else table) for t, o in zip(texts, own)]
                made = {"text": pa.array([t for t, _ in out], pa.string())}
                columns = [made[f.name] if f.name in made else part.column(f.name) for f in fields]
                columns.append(pa.array([n for _, n in out], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "n_entities"])

    return rows.mapInArrow(run, StructType([*fields, StructField("n_entities", LongType())]))


def _joined(base: DataFrame, key: bytes, again: DataFrame) -> DataFrame:
    """The same with a redrawn table of any size: it meets the mentions by entity, then the rows by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t in zip(batch.column("_text").to_pylist(), batch.column("text").to_pylist()):
                out += {(d, m.kind, m.entity) for m in mentions(t)}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["_text", "kind", "entity"])

    marked = base.withColumn("_text", F.sha2("text", 256))
    found = marked.select("_text", "text").mapInArrow(run, "_text string, kind string, entity string")
    own = (
        found.distinct()
        .join(again, ["kind", "entity"])
        .groupBy("_text")
        .agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias("again"))
    )
    return _applied(marked.join(own, "_text", "left").drop("_text"), key, {})
