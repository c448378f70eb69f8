"""Surrogates for private data.

Entities are found by patterns. Each gets a replacement of its own type drawn from a keyed stream
over its canonical form: digits for digits, letters for letters, the same punctuation, the country
code, issuer digit, checksum, gender and script of the original. Equal entities get equal
replacements throughout the corpus, however they are written: a phone number with and without its
country code, a name with any title or none. A name part is known from a title; it is then replaced
wherever its text has it again. Its gender is what all given-name mentions of the corpus agree on.
All distinct entities are then checked: of those that drew the same replacement, or one that is
itself an entity of the corpus, one keeps it at most and the others draw again, until no two share
one. What was drawn again, and the names with a gender, are a short list beside the texts; it is
broadcast while its checked size is small, and joined to the texts that need it beyond.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .shared import drop, materialise, read, row_count, small_batches

KEY = "surrogates-1"
#: Redrawn entities and names with a gender up to this many are broadcast (under 50 MB of at most 500 bytes each).
BROADCAST_ROWS = 100_000
MOST_ROUNDS = 64

FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "г-жа", "κα")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κος")
NEUTRAL = ("Dr", "Prof", "Mx")

_NAME = r"(?<!\w)(?P<title>" + "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True)) + r")(?P<dot>\.?\s)(?P<person>[^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z][^\W\d_]+){0,2})"
_PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])",
    "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|0[0-9]{1,4}[ /\-][0-9]{2,4}(?:[ \-][0-9]{2,4}){1,2}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}|(?<![+\-,$€£#/=])[0-9]{10})(?![\w]|[.,\-][0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "ssn": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "card": r"(?<![\w.])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![\w])",
    "secret": r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9_])",
}
_KEYED = re.compile(r"(?i)(?:token|secret|passwd|password|api[_\-]?key|access[_\-]?key)\s*[=:]\s*[\"']?(?P<v>[A-Za-z0-9_\-/+=]{12,})")
_DIGITAL = re.compile("|".join(f"(?P<{k}>{v})" for k, v in _PATTERNS.items()))
_PERSON = re.compile(_NAME)
_HINT = re.compile(r"[0-9@]")
_TITLES = re.compile("|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True)))


#: Country codes of one and two digits (ITU-T E.164); all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")


def lead(written: str) -> int:
    """How many of a phone number's digits come before the number proper: the country code after a
    plus, and zeros that stand for a trunk call."""
    digits = re.sub(r"[^0-9]", "", written)
    n = 0
    if written.startswith("+"):
        n = 1 if digits.startswith(ONE_DIGIT) else 2 if digits.startswith(TWO_DIGITS) else 3
    return n + len(digits[n:]) - len(digits[n:].lstrip("0"))


def _address6(text: str) -> str | None:
    """The full form of an IPv6 address of three groups or more."""
    try:
        return ipaddress.IPv6Address(text).exploded if sum(map(bool, text.split(":"))) > 2 else None
    except ValueError:
        return None


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, canonical form, gender) of the entities of a text, in order, without
    overlaps. The gender is f or m where a title gives it to a given name, or to the only name that
    it has; empty elsewhere."""
    out = []
    if _HINT.search(text):
        for m in _DIGITAL.finditer(text):
            canon = canonical(m.lastgroup, m.group())
            if canon:
                out.append((m.start(), m.end(), m.lastgroup, canon, ""))
        for m in _KEYED.finditer(text):
            s, e = m.span("v")
            if re.search("[0-9]", m["v"]) and not any(a < e and s < b for a, b, *_ in out):
                out.append((s, e, "secret", m["v"], ""))
    if _TITLES.search(text):
        taken = sorted((a, b) for a, b, *_ in out)
        names: dict[str, None] = {}
        titled: dict[int, str] = {}
        for m in _PERSON.finditer(text):
            gender = "f" if m["title"] in FEMALE else "m" if m["title"] in MALE else ""
            parts = list(re.finditer(r"[^\W\d_]+", m["person"]))
            for i, p in enumerate(parts):
                names[p.group()] = None
                titled[m.start("person") + p.start()] = gender if i < len(parts) - 1 or len(parts) == 1 else ""
        if names:  # these parts, in whatever place they stand; a title in front of one stays
            again = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(names, key=lambda x: (-len(x), x)))) + r")(?![^\W_])")
            at = 0
            for m in again.finditer(text):
                s, e = m.span()
                while at < len(taken) and taken[at][1] <= s:
                    at += 1
                if at == len(taken) or taken[at][0] >= e:
                    out.append((s, e, "name", m.group().casefold(), titled.get(s, "")))
    return sorted(out)


def canonical(kind: str, text: str) -> str | None:
    """What equal entities share however they are written; None for what only looks like one."""
    if kind == "phone":
        return re.sub(r"[^0-9]", "", text)[lead(text) :] or None
    if kind in ("card", "ssn"):
        return re.sub(r"[^0-9]", "", text)
    if kind == "ipv6":
        return _address6(text)
    if kind == "iban":
        return text.replace(" ", "")
    return text.lower() if kind == "email" else text


class Stream:
    """Numbers below a bound from a keyed hash of an entity."""

    def __init__(self, key: str, kind: str, canon: str, attempt: int) -> None:
        self.key, self.head = key.encode(), f"{kind}\0{attempt}\0{canon}".encode()
        self.block, self.n = 0, 0
        self.bits = 0

    def below(self, n: int) -> int:
        if self.n < 32:
            self.bits = int.from_bytes(hmac.new(self.key, self.head + self.block.to_bytes(4, "big"), hashlib.sha256).digest(), "big")
            self.block, self.n = self.block + 1, 256
        self.bits, self.n, out = self.bits >> 32, self.n - 32, (self.bits & 0xFFFFFFFF) * n >> 32
        return out


def luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


#: Syllables of made-up names by script, and endings by gender.
SYLLABLES = {
    "LATIN": ("ba be da de el fa ga jo ka le li lo ma mi na ne no ra re ri ro sa se ta ti to va ve vi zo".split(), {"f": "a ia ina elle".split(), "m": "o an us ek".split(), "n": "en er is on".split()}),
    "CYRILLIC": ("ба ве га да ел за ка ле ли ма ми на не ни ра ри ро са се та ти то".split(), {"f": "а ия ина ева".split(), "m": "ан ек ил ов".split(), "n": "ен ер ис ко".split()}),
    "GREEK": ("βα γα δε ελ θε κα λε λι μα μι να νι πα ρα ρο σα σο τα τι φι".split(), {"f": "α ια ινα η".split(), "m": "ος ης ας ων".split(), "n": "ου ακη ιδη ελ".split()}),
}


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split(" ")[0] if word else "LATIN"
    return name if name in SYLLABLES else "LATIN"


@lru_cache(maxsize=20_000)
def surrogate(key: str, kind: str, canon: str, attempt: int = 0, gender: str = "n") -> str:
    """The replacement of a canonical form at the given draw, itself canonical."""
    s = Stream(key, kind, canon, attempt)
    if kind == "phone":
        return str(1 + s.below(9)) + "".join(str(s.below(10)) for _ in canon[1:])
    if kind == "ipv6":  # groups that are zero stay, so that what can be left out stays the same
        groups = [g.lstrip("0") for g in canon.split(":")]
        return ":".join((hexed(1 + s.below(15)) + "".join(hexed(s.below(16)) for _ in g[1:])).rjust(4, "0") if g else "0000" for g in groups)
    if kind == "card":
        body = canon[0] + "".join(str(s.below(10)) for _ in canon[1:-1])
        if luhn(canon):
            last = str(s.below(10))
            return body + (last if luhn(body + last) else str((int(last) + 1) % 10))
        return body + next(d for d in "0123456789" if not luhn(body + d))
    if kind == "ssn":
        return "".join(str(s.below(10)) for _ in canon)
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "iban":
        body = "".join(_alike(c, s) for c in canon[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}"
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        host, dot, tld = domain.rpartition(".")
        more = "".join(str(s.below(10)) for _ in range(attempt // 4))
        return "".join(_alike(c, s) for c in local) + more + "@" + "".join(_alike(c, s) for c in host) + dot + tld
    if kind == "name":
        syllables, endings = SYLLABLES[script_of(canon)]
        n = 2 + s.below(2) + attempt // 4
        return "".join(syllables[s.below(len(syllables))] for _ in range(n)) + endings[gender][s.below(4)]
    hexadecimal = re.fullmatch(r"[0-9a-f]+", canon) is not None
    return "".join(hexed(s.below(16)) if hexadecimal else _alike(c, s) for c in canon)


def hexed(n: int) -> str:
    return "0123456789abcdef"[n]


def _alike(c: str, s: Stream) -> str:
    if c.isdigit():
        return str(s.below(10))
    if "a" <= c <= "z":
        return chr(97 + s.below(26))
    return chr(65 + s.below(26)) if "A" <= c <= "Z" else c


def render(kind: str, written: str, new: str) -> str:
    """A canonical replacement in the format in which the original was written."""
    if kind in ("phone", "card", "ssn", "iban"):
        digits = re.sub(r"[^0-9A-Za-z]", "", written)
        it = iter((digits[: lead(written)] if kind == "phone" else "") + new)
        return re.sub(r"[0-9A-Za-z]", lambda _: next(it, ""), written)
    if kind == "ipv6":
        return _render6(written, new)
    if kind == "email" and written.isupper():
        return new.upper()
    if kind == "name":
        return new.upper() if written.isupper() and len(written) > 1 else new if written.islower() else new.capitalize()
    return new


def _render6(written: str, new: str) -> str:
    groups = new.split(":")
    left, gap, right = written.partition("::")
    front = left.split(":") if left else []
    back = right.split(":") if right else []
    wide = [*zip(front, groups, strict=False), *zip(back, groups[8 - len(back) :], strict=True)]
    made = [g.lstrip("0").rjust(len(w), "0") or "0" for w, g in wide]
    out = ":".join(made[: len(front)]) + gap + ":".join(made[len(front) :])
    return out.upper() if any("A" <= c <= "F" for c in written) else out


def replace(text: str, key: str, known: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, int]:
    """The text with surrogates, and how many were put in. known: draw and gender of the entities
    for which these aren't 0 and n."""
    out, at = [], 0
    found = find(text)
    for s, e, kind, canon, _ in found:
        out += [text[at:s], render(kind, text[s:e], surrogate(key, kind, canon, *known.get((kind, canon), (0, "n"))))]
        at = e
    return "".join([*out, text[at:]]) if found else text, len(found)


_FOUND = "array<struct<kind:string,canon:string,gender:string>>"


def _mentions(text: Column) -> Column:
    @arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("canon", pa.string()), ("gender", pa.string())]))
        for texts in batches:
            out = []
            for at in range(0, len(texts), 64):
                out += [[{"kind": k, "canon": c, "gender": g} for _, _, k, c, g in find(x or "")] for x in texts.slice(at, 64).to_pylist()]
            yield pa.array(out, kind)

    return found(text)


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, canon) of the texts, with how many mentions each has and the gender that all
    mentions with one agree on; n if they don't, or none has one."""
    e = docs.select(F.explode(_mentions(F.col("text").cast("string"))).alias("e")).select("e.*")
    votes = lambda g: F.count(F.when(F.col("gender") == g, 1)) > 0
    gender = F.when(votes("f") & ~votes("m"), "f").when(votes("m") & ~votes("f"), "m").otherwise("n")
    return e.groupBy("kind", "canon").agg(F.count("*").alias("n"), gender.alias("gender"))


def _drawn(key: str):
    @arrow_udf("string")
    def draw(kinds: pa.Array, canons: pa.Array, attempts: pa.Array, genders: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (kinds, canons, attempts, genders)), strict=True)
        return pa.array([surrogate(key, *r) for r in rows], pa.string())

    return draw


def redrawn(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, attempt, gender) of found(kind, canon, gender) for the names with a gender and
    for the entities whose first draw collides, with the first draw that doesn't. In each round the
    entities that hold a replacement keep it and the smallest of a tie gets it."""
    draw = _drawn(key)("kind", "canon", "attempt", "gender")
    spark = found.sparkSession
    start = found.select("kind", "canon", "gender", F.lit(0).alias("attempt"))
    state = materialise(start.withColumn("new", draw), "draws")
    taken = materialise(found.select("kind", F.col("canon").alias("new")).distinct(), "taken")
    for _ in range(MOST_ROUNDS):
        first = state.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canon")).alias("best"), F.count("*").alias("n"))
        clash = first.join(taken.withColumn("real", F.lit(True)), ["kind", "new"], "left").where("n > 1 OR real").select("kind", "new", "best", F.coalesce("real", F.lit(False)).alias("real"))
        marked = state.join(clash, ["kind", "new"], "left")
        lost = F.col("best").isNotNull() & (F.col("real") | (F.col("best.canon") != F.col("canon")))
        marked = materialise(marked.select("kind", "canon", "gender", F.when(lost, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), lost.alias("lost"), "new"), "draws")
        drop(spark, state)
        if not marked.where("lost").limit(1).count():
            drop(spark, taken)
            return marked.where("attempt > 0 OR gender <> 'n'").select("kind", "canon", "attempt", "gender")
        after = marked.where("NOT lost").select("kind", "canon", "gender", "attempt", "new").unionByName(marked.where("lost").select("kind", "canon", "gender", "attempt", draw.alias("new")))
        state = materialise(after, "draws")
        drop(spark, marked)
    raise ValueError("a kind of entity has more members than its format has values")


_OUT = "text string, n_entities long"


def _replacer(key: str, known=None):
    @arrow_udf(_OUT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, redraws in batches:
            new, n = [], []
            for at in range(0, len(texts), 64):
                for x, own in zip(texts.slice(at, 64).to_pylist(), redraws.slice(at, 64).to_pylist(), strict=True):
                    mine = {(r["kind"], r["canon"]): (r["attempt"], r["gender"]) for r in own} if own else known.value if known is not None else {}
                    t, k = (None, 0) if x is None else replace(x, key, mine)
                    new.append(t)
                    n.append(k)
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(n, pa.int64())], ["text", "n_entities"])

    return run


_KNOWN = "array<struct<kind:string,canon:string,attempt:int,gender:string>>"


def pseudonymise(docs: DataFrame, key: str = KEY, broadcast_rows: int = BROADCAST_ROWS, into: str = "private") -> DataFrame:
    """docs(text, ...) with a struct column `into` of the new text and n_entities.

    A null text stays null with 0 entities; an empty text, and one without entities, stays as it
    is. Very long texts are read whole. Ids are not read, so null ids don't matter; repeated rows
    become alike. Of entities that draw one replacement the earlier draw, then the smaller canonical
    form, keeps it. An empty table stays empty. Other columns stay, and one that is called like
    `into` gives way.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = materialise(entities(docs), "entities")
    again = materialise(redrawn(found, key), "redrawn")
    text = F.col("text").cast("string")
    few = again.limit(broadcast_rows + 1).count() <= broadcast_rows
    if few:
        known = spark.sparkContext.broadcast({(r["kind"], r["canon"]): (r["attempt"], r["gender"]) for r in again.toLocalIterator()})
        return docs.withColumn(into, _replacer(key, known)(text, F.lit(None).cast(_KNOWN)))
    return _joined(docs, again, key, into)


def _joined(docs: DataFrame, again: DataFrame, key: str, into: str) -> DataFrame:
    """Only what a text needs of the list is joined to it, by a digest of the text. Texts that very
    many rows repeat are few, by construction at most 50,000, and looked up from a broadcast list;
    null texts need nothing."""
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__digest", F.sha2(text, 256))
    some = keyed.where(F.col("__digest").isNotNull())
    mentions = some.select("__digest", F.explode(_mentions(text)).alias("e")).select("__digest", "e.kind", "e.canon").distinct()
    own = mentions.join(again, ["kind", "canon"]).groupBy("__digest").agg(F.collect_list(F.struct("kind", "canon", "attempt", "gender")).alias("__again"))
    own = materialise(own, "own")
    least = max(500, -(-row_count(docs) // 50_000))
    hot = materialise(some.groupBy("__digest").count().where(F.col("count") > least).select("__digest").join(own, "__digest", "left"), "hot")
    rest = some.join(F.broadcast(hot.select("__digest")), "__digest", "left_anti").join(own, "__digest", "left")
    out = rest.unionByName(some.join(F.broadcast(hot), "__digest")).unionByName(keyed.where(F.col("__digest").isNull()).withColumn("__again", F.lit(None).cast(_KNOWN)))
    return out.withColumn(into, _replacer(key)(text, F.col("__again"))).drop("__digest", "__again")


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its surrogates put in; see pseudonymise for nulls and repeats."""
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "private.*")
