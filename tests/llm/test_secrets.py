import re

from ledgerline.llm import secrets
from tests.llm.cases import LONG, documents, nothing

KEY = "Xk9fQ2mZ7pLw3RtV8sNb"


def brute(text):
    """The base spans, by the patterns as they are given."""
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, name, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 18), (2, "hex", "[0-9a-f]+", 16)):
        found += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(x[2] for x in sorted(found))


TEXTS = [
    None, "", "é password=0123456789ab x", "PassWord : 'abcdefghijkl'", "token=short", "secret=token=abcdefghijklmnop", "AKIA" + "Z9" * 7, "AKIA" + "Z" * 13,
    "AKIAAKIA" + "B" * 12, "0123456789abcdef0", "0123456789abcde", "api_key = 0123456789abcdef0123", "ſecret=abcdefghijkl", "toKen=abcdefghijkl", "\U0001f600 passwd:aaaaaaaaaaaa",
    f"the secret is {KEY} now", f"{LONG} password=0123456789abcdef", "password=0123456789ab", "password=0123456789ab",
]


def test_base_spans_are_those_of_the_patterns(spark):
    rows = secrets.scan(documents(spark, TEXTS)).collect()
    assert sorted(r["base"] for r in rows) == sorted(brute(t or "") for t in TEXTS)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows) == sum(len(brute(t or "").split(",")) for t in TEXTS if brute(t or ""))
    assert secrets.scan(nothing(spark)).count() == 0


def test_novel_strings_are_added_and_known_ones_are_not():
    scanner = secrets.NoveltyScanner(b"connectionPool2 DatabasePassword1 AuthenticationManager2")
    assert scanner.spans(f"the secret is {KEY} now") == [(14, 14 + len(KEY), "novel")]
    assert scanner.spans("the secret AuthenticationManager2 class") == []
    assert scanner.spans("the secret is documentation now") == []
    assert scanner.spans(f"no announcement of {KEY}") == []
    repeated = f"{KEY} is shown; the password is {KEY}"
    assert scanner.spans(repeated) == []
    assert scanner.marginal_bytes(repeated, repeated.rindex(KEY), len(repeated)) < len(KEY) / 2


def test_novel_spans_keep_base_spans(spark):
    row = secrets.scan(documents(spark, [f"password=0123456789ab and secret {KEY}"])).first()
    assert row["base"] == "assign:0:21" and row["spans"].startswith("assign:0:21,novel:")


def test_dictionary_counts_all_texts(spark):
    texts = ["password alpha_name beta"] * 3 + ["token alpha_name"] * 2 + ["no announcement gamma_name", None]
    counts = {r["word"]: r["n_docs"] for r in secrets.identifier_counts(documents(spark, texts, list(range(7)))).collect()}
    assert counts == {"password": 3, "alpha_name": 5, "beta": 3, "token": 2}
    assert secrets.identifier_dictionary(documents(spark, texts, list(range(7))), size=1).endswith(b" alpha_name")


def test_every_string_behind_an_announcing_word_is_measured():
    scanner = secrets.NoveltyScanner(b"")
    keys = ["Xk39aLq8ZpT71bWm", "Qv72cRt5YnH94dJs", "Gf61eMw3UoB08hKz"]

    def novel(text):
        return [text[start:end] for start, end, kind in scanner.spans(text) if kind == "novel"]

    assert novel(f"The token for administration is {keys[0]}") == keys[:1]
    assert novel(f"The password for configuration: {keys[0]}") == keys[:1]
    assert novel(f"credential {keys[0]} {keys[1]}, then {'far away ' * 20}{keys[2]}\n{keys[0][::-1]}") == keys
    assert novel(f"secret=0123456789abX {keys[0]}\npasswd: abcdefabcdef0123 and {keys[1]}") == keys[:2]
    assert novel(f"SECRET_ACCESS_KEY={keys[0]}\nauthenticationManagers2 {keys[1]}\nbearer {keys[2]}") == keys


def test_candidates_of_long_lines_stand_once_and_in_order():
    line = " ".join(f"token administration{i}" for i in range(2000))
    found = list(secrets.candidates(f"{line}\n{line}"))
    assert found == sorted(set(found)) and len(found) == 4000


def test_dictionary_has_identifiers_of_texts_without_an_announcing_word(spark):
    texts = ["no announcement of BuildNumber2024x"] * 4 + ["token alpha_name"] * 3 + [None]
    docs = documents(spark, texts, list(range(8)))
    counts = {r["word"]: r["n_docs"] for r in secrets.identifier_counts(docs, having=None).collect()}
    assert counts == {"announcement": 4, "BuildNumber2024x": 4, "token": 3, "alpha_name": 3}
    primed = secrets.identifier_dictionary(docs)
    assert primed.endswith(b" token alpha_name announcement BuildNumber2024x")
    assert secrets.NoveltyScanner(primed).spans("the token BuildNumber2024x") == []
