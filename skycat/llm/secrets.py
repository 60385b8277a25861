"""Operator 6: secrets by patterns, and by dictionary-primed zstandard novelty.

Base spans: assignments to password-like names, access keys and long hex runs, each
kind leftmost and non-overlapping, too short matches dropped.

Novelty: in a sensitive context every unbroken string of ``LEAST`` characters or more is
a candidate.  A context is a name such as key, secret, token, password, auth or credential,
a whole word or a word of a compound (apiKey, db_password, authtoken; not author or monkey),
up to ``REACH`` characters before on the same line, or one that ends the line (a PEM
header, or a name with : or = and nothing behind) before the value's line; it goes on over following
lines that hold nothing but one string, as the body of a PEM block does.  A name and its
value may be one token (key-..., /auth/...): the candidate then begins behind the name and
the separators after it, and ends with the token or before its next name.  Whether it has
digits does not matter.  Its cost is the number of bytes it adds to the zstandard frame of
the text around it, by a compressor primed with a dictionary: size(before + candidate +
after) - size(before + after), all three spelled out, that is with a space at each hump,
underscore, hyphen, slash and plus, and in lower case.  The dictionary holds the words of a
public tokenizer's vocabulary (its path is a parameter), the most frequent last, and a list
of names that stand in configurations.  Words and identifiers made of known parts are cheap
there, random strings are not (and other random strings nearby are left out of the
surroundings, as are a candidate's own copies), and humps at random places cost them more: a candidate that
costs ``NOVEL`` per cent of its length or more is reported as kind ``novel``, unless a base
span already covers part of it.

Rates of that limit (tests/llm/test_secrets.py): of 2,100 random strings of 16 to 64
characters over seven alphabets 3 are missed (one-case letters), none of them among other
keys; of 1,500 identifiers of 16 characters and more in Python and Spark code 7 cost as
much, most of them abbreviations; of 66 lower-case compounds one, a row of doubled letters.

One pass over the rows without a shuffle.  Defined cases: null or empty text (no
spans), very long texts (whole), repeated rows (a result row each), null doc_ids
(kept), empty tables, extra columns (kept by ``redacted``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.session import ship_package

from .bpe import read_ranks
from .common import table

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINTS = ("passw", "secret", "token", "api")

#: Sensitive names up to a word's end or hump; how far before a candidate; its least length; cost in per cent of its length; text around it.
CONTEXT = re.compile(
    r"(?i:keys?|secrets?|tokens?|passw(?:or)?ds?|passphrases?|pwds?|o?auth(?:orization|entication|enticate|[nz])?|cred(?:s|entials?)?|bearer|private|signatures?)"
    r"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?=[A-Z][a-z]))",
    re.ASCII,
)
_CONTEXT_HINTS = ("key", "secret", "token", "passw", "passp", "pwd", "auth", "cred", "bearer", "private", "signature")
#: Where a word or a hump begins; names that may stand anywhere in a word; what the others may be joined to.
_BEGINS = re.compile(r"(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])", re.ASCII)
_ANYWHERE = ("passw", "passp", "token", "secret", "credential")
_JOINED = ("api", "access", "secret", "private", "public", "auth", "client", "session", "ssh", "master", "signing", "encryption", "service", "account", "user", "db")
REACH = 40
LEAST = 16
_STRING = rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}"
CANDIDATE = re.compile(_STRING)
START = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]")
#: Between a sensitive name and the rest of its token; the rest.
GLUE = re.compile(r"[+/_-]+")
REST = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: From a name to the end of its line if no value stands there, and a line that is one value.
HEADER = re.compile(
    r"""["']?[^\S\n]*[:=][^\S\n]*(?:[|>][+-]?)?["']?[^\S\n]*\n|[\x20A-Z0-9]*-----[^\S\n]*\n(?:[A-Za-z0-9-]+:\x20[^\n]*\n)*(?:[^\S\n]*\n)?"""
)
VALUE_LINE = re.compile(rf"""[^\S\n]*(?:-\x20+)?["']?([A-Za-z0-9+/_-]+={{0,2}})["']?[,;]?[^\S\n]*(?:\n|\Z)""")
NOVEL = 79
AROUND = 256

#: Spelling out: humps and separators become spaces.
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_/+-]+")
#: Least length of a vocabulary's words in the dictionary; level of the compressor.
WORD_LEAST = 4
LEVEL = 12
#: Names of configurations and code that a compressor may know beforehand.
NAMES = """the and that with this from have for not are was were been will would could should about which their there
    access_key secret_key api_key private_key public_key client_id client_secret access_token refresh_token id_token
    password username user_name email address authorization authentication bearer basic credential credentials signature
    session_id request_id response content_type application/json text/plain charset utf-8 https:// http:// www. .com .org .net
    AKIA import export return function class def self None True False null undefined const static public private protected
    string integer boolean float double array object config settings environment variable default example test production
    development staging localhost 127.0.0.1 0.0.0.0 ssh-rsa BEGIN END PRIVATE KEY CERTIFICATE sha256 sha1 md5 base64 hex
    0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 aaaaaaaa xxxxxxxx your_key_here
    changeme placeholder redacted"""

#: Candidates are measured in pieces of this many characters.
PIECE = 64

_presses: dict[str, object] = {}


def spelled(text: str) -> bytes:
    return _HUMP.sub(" ", text).lower().encode("utf-8", "replace")


def dictionary(vocabulary: str) -> bytes:
    """The words of a tokenizer's vocabulary, the most frequent last (nearest), then ``NAMES``."""
    words = {w: None for t in read_ranks(vocabulary) if re.fullmatch(rb"[a-z]{%d,}" % WORD_LEAST, w := t.strip().lower())}
    return b" ".join([*reversed(words), spelled(" ".join(NAMES.split())), b""])


#: Begins each frame.  Every byte value twice, in orders without common runs: a table of symbol
#: lengths gains nothing then, and what no match covers costs a byte a character, whatever its
#: alphabet.  The names are one match: the frame without the candidate is a compressed one too.
LEAD = bytes((167 * i + 13) % 256 for i in range(256)) + bytes((91 * i + 7) % 256 for i in range(256)) + spelled(" ".join(NAMES.split()))[:300]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _press(vocabulary: str):
    """The worker's compressor."""
    if vocabulary not in _presses:
        import zstandard

        prime = zstandard.ZstdCompressionDict(dictionary(vocabulary), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _presses[vocabulary] = zstandard.ZstdCompressor(level=LEVEL, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)
    return _presses[vocabulary]


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), ordered; ``low`` is the text in lower case, to skip what can't match."""
    out = []
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def cost(before: str, candidate: str, after: str, vocabulary: str) -> int:
    """Bytes that the candidate adds to its compressed surroundings."""
    press = _press(vocabulary)
    a, z = LEAD + spelled(before), spelled(after)
    pieces = [spelled(candidate[i : i + PIECE]) for i in range(0, len(candidate), PIECE)]
    return sum(len(press.compress(a + c + z)) for c in pieces) - len(pieces) * len(press.compress(a + z))


@lru_cache(1 << 12)
def _ordinary(string: str, vocabulary: str) -> bool:
    return 100 * cost("", string, "", vocabulary) < NOVEL * len(string)


def surroundings(text: str, candidate: str, vocabulary: str) -> str:
    """Text around a candidate, without its own copies and other strings that no dictionary makes
    cheap: neither makes it ordinary."""
    return CANDIDATE.sub(lambda m: m[0] if _ordinary(m[0], vocabulary) else "", text.replace(candidate, ""))


def _named(text: str, m: re.Match) -> bool:
    """Whether a sensitive name is a word, or a word of a compound."""
    a = m.start()
    return bool(_BEGINS.match(text, a)) or m[0].lower().startswith(_ANYWHERE) or text[max(0, a - 12) : a].lower().endswith(_JOINED)


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the candidates of all sensitive contexts, as they come; one may come again, or start inside another."""
    done = token_end = 0  # value lines are read once, however many names stand before them
    names = [m for m in CONTEXT.finditer(text) if _named(text, m)]
    for m, after in zip(names, [*names[1:], None]):
        if glue := GLUE.match(text, m.end()):
            # up to the next name in the token, and for the first name the whole rest
            ends = []
            if m.end() >= token_end:
                token_end = REST.match(text, m.end()).end()
                ends.append(token_end)
            ends.append(min(after.start(), token_end) if after else token_end)
            yield from ((glue.end(), b) for b in ends if b - glue.end() >= LEAST)
        stop = text.find("\n", m.end(), m.end() + REACH)
        stop = m.end() + REACH if stop < 0 else stop
        for first in START.finditer(text, m.end(), stop):
            if c := CANDIDATE.match(text, first.start()):
                yield c.span()
        header = HEADER.match(text, m.end())
        at = header.end() if header else -1
        while at >= done and (line := VALUE_LINE.match(text, at)):
            if line.end(1) - line.start(1) >= LEAST:
                yield line.span(1)
            done = at = line.end()


def novel_spans(text: str, low: str, taken: list[tuple[int, int, str]], vocabulary: str) -> list[tuple[int, int, str]]:
    if not any(h in low for h in _CONTEXT_HINTS):
        return []
    out, t, end = [], 0, -1
    for a, b in sorted(set(_candidates(text)), key=lambda s: (s[0], -s[1])):
        while t < len(taken) and taken[t][1] <= a:
            t += 1
        # what is reported is not reported in parts again
        if b <= end or any(s < b and e > a for s, e, _ in taken[t : t + 3]):
            continue
        before = surroundings(text[max(0, a - AROUND) : a], text[a:b], vocabulary)
        after = surroundings(text[b : b + AROUND], text[a:b], vocabulary)
        if 100 * cost(before, text[a:b], after, vocabulary) >= NOVEL * (b - a):
            out.append((a, b, "novel"))
            end = b
    return out


def find(text: str, vocabulary: str | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of one text, ordered by start, then kind."""
    low = text.lower()
    base = base_spans(text, low)
    novel = novel_spans(text, low, base, vocabulary or default_vocabulary())
    return base, sorted(base + novel, key=lambda s: (s[0], KINDS.index(s[2]))) if novel else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scanned(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, spans by kind, digest of the base spans, and all spans of every row."""
    ship_package(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = find(text.as_py() or "", vocabulary)
                rows.append(
                    (
                        *(sum(k == kind for _, _, k in every) for kind in KINDS),
                        hashlib.sha256(joined(base).encode()).hexdigest(),
                        joined(every),
                    )
                )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    )


def _without(text: str, vocabulary: str) -> str:
    every = find(text, vocabulary)[1]
    if not every:
        return text
    out, at = [], 0
    for a, b, kind in every:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All rows and columns, each span replaced by its kind in brackets, n_chars to match."""
    ship_package(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else _without(t, vocabulary) for t in batch.column("text").to_pylist()]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([t if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)


def op6_zstd_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
