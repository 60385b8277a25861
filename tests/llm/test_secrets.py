"""Operator 6 on labelled strings: random keys against ordinary long words, identifiers and paths."""

import pathlib
import random
import re
import string
import sysconfig

import pyspark
import pytest

from skycat.llm import secrets

ALPHABETS = {
    "letters and digits": string.ascii_letters + string.digits,
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "base64": string.ascii_letters + string.digits + "+/",
    "lower and digits": string.ascii_lowercase + string.digits,
    "letters": string.ascii_letters,
    "upper hex": "0123456789ABCDEF",
}
LENGTHS = (16, 20, 24, 32, 40, 64)


def novel(text):
    return [text[a:b] for a, b, kind in secrets.find(text)[1] if kind == "novel"]


def drawn(alphabet, n=300):
    rng = random.Random(alphabet)
    return ["".join(rng.choice(ALPHABETS[alphabet]) for _ in range(rng.choice(LENGTHS))) for _ in range(n)]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_keys_are_found(alphabet):
    """At most 1 in 100 of any alphabet is missed."""
    missed = [k for k in drawn(alphabet) if novel(f"the signing key is {k} in this file") != [k]]
    assert len(missed) <= 3, missed


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_keys_among_random_keys_are_found(alphabet):
    """Keys on lines of their own, one after the other, as in a key file."""
    keys = drawn(alphabet, 100)
    text = "private_key: |\n" + "".join(f"  {k}\n" for k in keys) + "name: x\n"
    found = novel(text)
    assert len([k for k in keys if k not in found]) <= 1


def test_identifiers_are_left_alone():
    """At most 3 in 100 identifiers of 16 characters and more of the installed Python and Spark code are reported."""
    files = [*sorted(pathlib.Path(sysconfig.get_paths()["stdlib"]).glob("*.py")), *sorted(pathlib.Path(pyspark.__file__).parent.glob("sql/*.py"))]
    names = {n for f in files for n in re.findall(r"\b[A-Za-z_][A-Za-z0-9_]{15,}\b", f.read_text(errors="replace"))}
    some = random.Random(3).sample(sorted(names), 1500)
    reported = [n for n in some if novel(f"the token is {n} in this file")]
    assert len(reported) <= 45, reported


@pytest.mark.parametrize(
    "text",
    [
        "The author of responsibilities and institutionalization said so in the book",
        "the key electroencephalographic findings",
        "the key responsibilities of telecommunications and deinstitutionalization",
        "Incredible misunderstandings/misinterpretations",
        "private static final IllegalArgumentException",
        "private AbstractAuthenticationProcessingFilter counterrevolutionaries",
        "auth: see DefaultSecurityFilterChainConfiguration",
        "key https://example.org/docs/getting-started/installation-guide and so on",
        "a key point: wp-content/uploads/2019/03/header-image-large",
        "token = getUserAuthenticationTokenFromRequest(request)"[8:],
    ],
)
def test_ordinary_text_is_left_alone(text):
    assert novel(text) == []


def test_names_are_words():
    key = drawn("letters and digits", 1)[0]
    for name in ("key", "apiKey", "API_KEY", "APIKey", "accesskey", "keyId", "dbpassword", "Authorization", "OAuth", "authtoken", "creds", "credentials", "ssh-keys"):
        assert novel(f"{name} is {key} here") == [key], name
    for name in ("author", "Authority", "Incredible", "credit", "monkey", "keyboard", "secretary", "tokenizer", "turkeys", "authored"):
        assert novel(f"{name} is {key} here") == [], name


def test_redacted_prose_stays(spark):
    text = "The author of responsibilities and institutionalization said so in the book"
    key = drawn("letters", 1)[0]
    docs = spark.createDataFrame([(1, text, "x"), (2, f"the api key {key}", "y"), (3, None, None), (4, "", "z")], "doc_id long, text string, extra string")
    got = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert got == {1: text, 2: "the api key [novel]", 3: None, 4: ""}


def test_dictionary_of_another_vocabulary(tmp_path):
    """The vocabulary's path is a parameter; words in it are cheap."""
    import base64

    word = "qxvzkjwqpf"
    ranks = tmp_path / "v.tiktoken"
    ranks.write_bytes(b"".join(base64.b64encode(t.encode()) + f" {i}\n".encode() for i, t in enumerate([word, "wkjzq", "abc"])))
    dic = secrets.dictionary(str(ranks))
    assert word.encode() in dic and b"abc " not in dic[: len(word) + 8]
    text = "the key qhxzvbkjwmqpfgtcxydz here"
    assert not any(k == "novel" for _, _, k in secrets.find(f"the key {word}-{word}-{word} here", str(ranks))[1])
    assert any(k == "novel" for _, _, k in secrets.find(text)[1])
