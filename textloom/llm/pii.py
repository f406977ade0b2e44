"""PII: keyed, type-consistent surrogates.

Detected: e-mail addresses, IPv4 addresses, phone, card, social-security and bank-account numbers, secrets
(long hexadecimal or base-64 tokens after a secret's name, and bare hexadecimal ones), and personal names
with a title or a known given name. Each entity has a canonical form (case, separators and country code do
not count), so all its mentions get one surrogate, and each mention keeps its own format: case,
separators, country code, length, number class, and for names gender and script.

Digits and letters are replaced by keyed Feistel permutations of all strings of the same shape, so
different entities cannot get equal surrogates; card numbers keep their Luhn property, IPv4 addresses
their private range. Given names are drawn by key from lists by gender and script and family names are
built from syllables; those can collide. The collision check compares all distinct entities: a surrogate
that two entities share, or that is itself an entity of the corpus, is drawn again under the next attempt number.
Names that still clash after MAX_ATTEMPTS are numbered, and the number is spelt in syllables, more of them than any
name of the corpus or of the draws has; a title keeps the gender of a given name made so. If a clash is left then
(values of other kinds can use up all strings of their shape), an error is raised.
The entities with a later attempt reach their documents by a join on the id.

The key is the caller's secret; whoever has it can undo the permutations.

Defined cases: a null text stays null; an empty text stays empty; repeated rows get equal texts; a null id
works; a text without entities is left alone to the byte; a very long text is searched whole, in time that grows with its
length; where two kinds match, the earlier kind wins, and within one the first match; an empty table gives no rows.
Columns other than the text pass through ``replace_pii``, whatever their names; where one is called ``n_entities`` or
``kinds``, the added column gets another name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, ordered_slots, read_documents

#: Of the registered query, over invented texts. Real texts need a key of one's own.
QUERY_KEY = b"textloom surrogate key 1"
MAX_ATTEMPTS = 20
#: Attempts from here on are numbers of names; in base 16 they have at least five digits, a drawn name has four syllables.
NUMBERED = 16**4

# fixed values: titles, given names and syllables, by script and gender
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа"),
    "n": ("Dr", "Prof", "Professor", "Mx"),
}
GIVEN = {
    ("latin", "m"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Daniel", "Paul", "Peter", "Hans", "Klaus", "Jürgen", "Pierre", "Jean", "Luis", "Carlos", "José", "Juan", "Miguel"),
    ("latin", "f"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Emma", "Ursula", "Sabine", "Marie", "Sophie", "Camille", "María", "Carmen", "Lucía", "Elena", "Isabel"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина"),
}
SYLLABLES = {
    "latin": ("bar", "den", "fel", "gor", "hal", "kin", "lor", "mas", "nev", "par", "ros", "sol", "tan", "ver", "wil", "zan"),
    "cyrillic": ("бар", "ден", "фел", "гор", "хал", "кин", "лор", "мас", "нев", "пар", "рос", "сол", "тан", "вер", "вил", "зан"),
}
_SECOND_LEVEL = {"co", "com", "org", "net", "ac", "gov", "edu"}
_GENDER = {n.casefold(): (s, g) for (s, g), names in GIVEN.items() for n in names}
_TITLE_GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts}

_UP = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]"
_NAME = rf"{_UP}[^\W\d_]+(?:-{_UP}[^\W\d_]+)?"
_titles = "|".join(sorted({t for ts in TITLES.values() for t in ts}, key=len, reverse=True))
_given = "|".join(sorted({n for ns in GIVEN.values() for n in ns}, key=len, reverse=True))
_given_upper = "|".join(n.upper() for n in sorted({n for ns in GIVEN.values() for n in ns}, key=len, reverse=True))
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]*[\w+-]@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}"),
    "secret": re.compile(r"(?i)(?:(?<=[\"'=: ])|(?<![\w-]))(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|gho)[_-][A-Za-z0-9_]{16,})(?![\w-])|(?<![\w-])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9+/_\-]{8,}=*)"),
    "iban": re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"),
    "ipv4": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w])|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w])|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    "name": re.compile(rf"\b(?:(?:{_titles})\.? )(?:{_NAME})(?: {_NAME})?|\b(?:{_given}) {_NAME}|\b(?:{_given_upper}) {_UP}{{2,}}\b"),
}
_DIGIT = re.compile(r"\d")
_HINT = re.compile(rf"(?i)token|secret|passw|key|akia|[sp]k[_-]|gh[po]_|[0-9a-f]{{32}}")
_HEX = re.compile(r"[0-9a-f]{32}")
_HINTS = ("token", "secret", "passw", "key", "akia", "sk_", "sk-", "pk_", "pk-", "ghp_", "gho_")
_NAME_HINT = re.compile(rf"\b(?={_UP})(?:{_titles}|{_given}|{_given_upper})\b")


def _may_hold_secret(text: str) -> bool:
    """What ``_HINT`` finds, by plain substrings unless the text has letters that match others without case."""
    if any(c in text for c in "İıſ\u212a"):
        return _HINT.search(text) is not None
    low = text.lower()
    return any(h in low for h in _HINTS) or _HEX.search(low) is not None


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, left to right, none overlapping; earlier kinds win."""
    kinds = []
    if "@" in text:
        kinds.append("email")
    if _may_hold_secret(text):
        kinds.append("secret")
    if _DIGIT.search(text):
        kinds += ["iban", "ipv4", "ssn", "card", "phone"]
    if _NAME_HINT.search(text):
        kinds.append("name")
    found: list[tuple[int, int, str]] = []
    for kind in kinds:
        for m in PATTERNS[kind].finditer(text):
            a, b = m.span(1) if m.lastindex else m.span()
            at = bisect_left(found, (a,))
            if (not at or found[at - 1][1] <= a) and (at == len(found) or b <= found[at][0]):
                found.insert(at, (a, b, kind))
    return found


def _round(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), key=key[:64], digest_size=16).digest(), "big")


def permute(symbols: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed bijection of mixed-radix strings: a Feistel network over the two halves."""
    if not symbols:
        return symbols
    if len(symbols) == 1:
        return [(symbols[0] + _round(key, tweak, sizes)) % sizes[0]]
    out, cut = list(symbols), len(symbols) // 2
    for r in range(6):
        left, right = slice(0, cut), slice(cut, None)
        if r % 2:
            left, right = right, left
        f = _round(key, tweak, sizes, r, out[right])
        for i in range(*left.indices(len(out))):
            f, d = divmod(f, sizes[i])
            out[i] = (out[i] + d) % sizes[i]
            if not f:
                f = _round(key, tweak, r, i, out[right])
    return out


_AZ = "abcdefghijklmnopqrstuvwxyz"


@lru_cache(4096)
def _alphabet(c: str) -> str:
    """The letters, or the digits, that a character can turn into: those of its script's block, in lower case."""
    if c.isascii():
        return "0123456789" if c.isdigit() else _AZ if c.isalpha() else ""
    block = [chr(k) for k in range(ord(c) & ~127, (ord(c) & ~127) + 128)]
    if c.isdecimal():
        return "".join(x for x in block if x.isdecimal())
    return "".join(x for x in block if x.isalpha() and x.lower() == x and len(x.upper()) == 1)


def reshape(text: str, key: bytes, tweak: str, hexadecimal: bool = False) -> str:
    """Permute the letters and digits of a lower-case string among strings of the same shape and scripts."""
    tables = ["0123456789abcdef" if hexadecimal and c.isascii() and c.isalnum() else _alphabet(c) for c in text]
    at = [i for i, t in enumerate(tables) if t and text[i] in t]
    got = permute([tables[i].index(text[i]) for i in at], [len(tables[i]) for i in at], key, tweak)
    out = list(text)
    for i, v in zip(at, got, strict=True):
        out[i] = tables[i][v]
    return "".join(out)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def canonical(mention: str, kind: str) -> str:
    """What is the same in all mentions of an entity."""
    if kind == "email":
        return mention.lower()
    if kind == "secret":
        return mention.lower() if re.fullmatch(r"[0-9A-Fa-f]+", mention) else mention
    if kind == "name":
        title, given, rest = _name_parts(mention)
        return f"{_gender(title, given)}|{given.casefold()}|{rest.casefold()}"
    if kind == "phone":
        return _national(mention)
    return re.sub(r"[^0-9A-Za-z.]" if kind == "ipv4" else r"[^0-9A-Za-z]", "", mention).upper()


def _national(phone: str) -> str:
    """The digits of a phone number without its country code."""
    m = re.match(r"\+\d{1,3}(?=[ .(-])", phone)
    return re.sub(r"\D", "", phone[m.end() :] if m else phone)


def _name_parts(mention: str) -> tuple[str, str, str]:
    words = mention.split(" ")
    title = words.pop(0) if words[0].rstrip(".").casefold() in _TITLE_GENDER else ""
    if len(words) > 1:
        return title, words[0], " ".join(words[1:])
    return title, ("", words[0])[words[0].casefold() in _GENDER], "" if words[0].casefold() in _GENDER else words[0]


def _gender(title: str, given: str) -> str:
    known = _GENDER.get(given.casefold())
    g = known[1] if known else _TITLE_GENDER.get(title.rstrip(".").casefold(), "n")
    return g


def surrogate(canon: str, kind: str, attempt: int = 0, *, key: bytes) -> str:
    """The canonical form of an entity's surrogate."""
    tweak = f"{kind}:{attempt}"
    if kind == "email":
        local, domain = canon.rsplit("@", 1)
        labels = domain.split(".")
        # what stays: a domain reserved for examples, or the public end of the name
        keep = 2 if labels[-2] == "example" else 1 + (len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND_LEVEL)
        for i in range(len(labels) - keep):
            labels[i] = reshape(labels[i], key, f"{tweak}:{len(labels) - i}")
        return reshape(local, key, f"{tweak}:{domain}") + "@" + ".".join(labels)
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+", canon):
            return reshape(canon, key, tweak, True)
        flat = reshape(canon.lower(), key, f"{tweak}:{''.join('u' if c.isupper() else 'l' for c in canon)}")
        return _as_cased(flat, canon)
    if kind == "ipv4":
        octets = [int(x) for x in canon.split(".")]
        keep = 1 if octets[0] in (10, 127) else 2 if octets[:2] == [192, 168] or octets[0] == 172 and 16 <= octets[1] < 32 else 0
        private = lambda o: o[0] in (0, 10, 127) or o[:2] == [192, 168] or o[0] == 172 and 16 <= o[1] < 32 or o[0] >= 224
        if not keep and private(octets):
            keep = 1
        out = octets
        while True:  # walk the cycle until the address is again of its own class
            out = octets[:keep] + permute(out[keep:], [256] * (4 - keep), key, f"{tweak}:{octets[:keep]}")
            if keep or not private(out):
                return ".".join(map(str, out))
    if kind == "card":
        body = reshape(canon[:-1], key, tweak)
        return body + str((luhn(body) + int(canon[-1]) - luhn(canon[:-1])) % 10)
    if kind == "iban":
        return canon[:2] + reshape(canon[2:].lower(), key, f"{tweak}:{canon[:2]}").upper()
    if kind == "name":
        gender, given, rest = canon.split("|")
        script = "cyrillic" if re.search(r"[а-яё]", given + rest) else "latin"
        if attempt >= NUMBERED:
            digits = permute([int(c, 16) for c in f"{attempt:x}"], [16] * len(f"{attempt:x}"), key, f"name:{script}")
            spelt = "".join(SYLLABLES[script][d] for d in digits)
            if not rest:
                return f"{gender}|{spelt}|"
        drawn = _round(key, tweak, canon)
        if gender == "n":
            drawn, g = divmod(drawn, 2)
            names = GIVEN[script, "mf"[g]]
        else:
            names = GIVEN[script, gender]
        drawn, i = divmod(drawn, len(names))
        family = ""
        for _ in range(4):
            drawn, j = divmod(drawn, 16)
            family += SYLLABLES[script][j]
        return f"{gender}|{names[i].casefold() if given else ''}|{(spelt if attempt >= NUMBERED else family) if rest else ''}"
    return reshape(canon.lower(), key, tweak).upper()


def _as_cased(new: str, like: str) -> str:
    """``new`` in the case of ``like``, character by character where lengths agree."""
    if len(new) == len(like):
        return "".join(n.upper() if c.isupper() else n for n, c in zip(new, like, strict=True))
    if like.isupper() and len(like) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if like[:1].isupper() else new


def render(mention: str, kind: str, new: str) -> str:
    """A surrogate's canonical form in the format of a mention."""
    if kind == "email":
        return _as_cased(new, mention)
    if kind == "secret":
        return new.upper() if re.fullmatch(r"[0-9A-F]*[A-F][0-9A-F]*", mention) else _as_cased(new, mention) if not re.fullmatch(r"[0-9a-fA-F]+", mention) else new
    if kind == "name":
        title, given, rest = _name_parts(mention)
        _, new_given, new_rest = new.split("|")
        style = lambda x, like: x.upper() if like.isupper() else "-".join(p[:1].upper() + p[1:] for p in x.split("-"))
        return " ".join(p for p in (title, style(new_given, given) if given else "", style(new_rest, rest) if rest else "") if p)
    if kind == "ipv4":
        return new
    if kind == "phone":
        m = re.match(r"\+\d{1,3}(?=[ .(-])", mention)
        head, mention = (m.group(), mention[m.end() :]) if m else ("", mention)
    else:
        head = ""
    symbols = iter(new)
    return head + "".join(next(symbols) if c.isalnum() else c for c in mention)


def entities(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, canon): each entity of each document once."""
    kind_of_id = dict(df.dtypes)[id_col]

    def run(batches):
        for b in batches:
            rows, kinds, canons = [], [], []
            for i, t in enumerate(b.column(1)):
                if t.is_valid:
                    text = t.as_py()
                    for k, c in {(k, canonical(text[x:y], k)) for x, y, k in detect(text)}:
                        rows.append(i)
                        kinds.append(k)
                        canons.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(canons, pa.string())], ["id", "kind", "canon"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind_of_id}, kind string, canon string")


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """Add ``new`` to (kind, canon, attempt)."""

    def run(batches):
        for b in batches:
            new = [surrogate(c, k, a, key=key) for k, c, a in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(new, pa.string())], ["kind", "canon", "attempt", "new"])

    return rows.select("kind", "canon", F.col("attempt").cast("long")).mapInArrow(run, "kind string, canon string, attempt long, new string")


def _numbered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with numbers as the attempts of names: their spelling is longer than that of any known name."""
    syllables = "|".join(s for names in SYLLABLES.values() for s in names)
    spelt = [F.regexp_extract("canon", like, 1) for like in (rf"^[^|]*\|((?:{syllables})+)\|", rf"\|((?:{syllables})+)$")]
    longest = known.where("kind = 'name'").agg(F.max(F.greatest(*(F.length(s) for s in spelt)))).first()[0] or 0
    first = 16 ** max(4, longest // 3)
    names = ordered_slots(rows.where("kind = 'name'"), "kind", ["canon"], "slot", "pii-numbered")
    return rows.where("kind <> 'name'").union(names.select("kind", "canon", (F.lit(first) + F.col("slot")).alias("attempt")))


def resolve(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt, new) of all distinct entities, without collisions; raises if there is no such."""
    known = materialize(found.select("kind", "canon").distinct(), "pii-entities")
    drawn = materialize(_drawn(known.withColumn("attempt", F.lit(0)), key), "pii-drawn")
    for left in range(MAX_ATTEMPTS + 1, -1, -1):
        taken = known.select("kind", F.col("canon").alias("new"), F.lit(True).alias("real"))
        least = drawn.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count(F.lit(1)).alias("n"))
        clash = least.join(taken, ["kind", "new"], "left").where("n > 1 or real").select("kind", "new", "first", F.coalesce("real", F.lit(False)).alias("real"))
        clash = materialize(clash, "pii-clashes")
        if clash.isEmpty():
            break
        if not left:
            raise ValueError(f"surrogates still clash: {clash.groupBy('kind').count().collect()}")
        # the first of a clash keeps its surrogate unless that is an entity; the others draw again
        marked = drawn.join(clash, ["kind", "new"], "left").withColumn("again", F.coalesce(F.col("real") | (F.struct("attempt", "canon") != F.col("first")), F.lit(False)))
        redo = marked.where("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if left == 1:
            redo = _numbered(redo, known)
        redo = _drawn(redo, key)
        drawn = materialize(marked.where("not again").select("kind", "canon", "attempt", "new").union(redo), "pii-drawn")
    return drawn


def replace_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: bytes) -> DataFrame:
    """``df`` with surrogates in its texts, and ``n_entities`` and ``kinds`` of what was replaced."""
    own_id, held = fresh(df, "id", "later")
    added = [n if n not in {c.lower() for c in df.columns} else fresh(df, n) for n in ("n_entities", "kinds")]
    found = materialize(entities(df, id_col, text_col), "pii-found")
    later = materialize(resolve(found, key).where("attempt > 0"), "pii-later")
    rows = df
    if not later.isEmpty():
        own = found.join(later, ["kind", "canon"]).groupBy(F.col("id").alias(own_id)).agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias(held))
        rows = df.join(materialize(own, "pii-own"), F.col(id_col).eqNullSafe(F.col(own_id)), "left").drop(own_id)
    else:
        rows = df.withColumn(held, F.lit(None).cast("array<struct<kind:string,canon:string,attempt:int>>"))
    columns = df.columns
    at_text = columns.index(text_col)

    def run(batches):
        for b in batches:
            texts, sizes, kinds = [], [], []
            later = b.column(len(columns))
            for t, more in zip(b.column(at_text), later, strict=True):
                text = t.as_py()
                spans = detect(text) if text else []
                if spans:
                    attempts = {(e["kind"], e["canon"]): e["attempt"] for e in more.as_py() or ()}
                    parts, at = [], 0
                    for x, y, k in spans:
                        c = canonical(text[x:y], k)
                        parts += [text[at:x], render(text[x:y], k, surrogate(c, k, attempts.get((k, c), 0), key=key))]
                        at = y
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                sizes.append(len(spans))
                kinds.append(sorted({k for _, _, k in spans}))
            arrays = [pa.array(texts, pa.string()) if i == at_text else b.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sizes, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], [*columns, *added])

    schema = df.withColumn(added[0], F.lit(0).cast("long")).withColumn(added[1], F.array(F.lit(""))).schema
    for f in schema.fields:
        f.nullable = True
    return rows.select(*(F.col(f"`{c}`") for c in columns), held).mapInArrow(run, schema)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(read_documents(spark, sf_dir).select("doc_id", "text"), key=QUERY_KEY)
