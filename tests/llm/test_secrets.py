import hashlib
import re

from folioscope.llm.secrets import scan_secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, base string, value string"
KINDS = {
    "assign": (r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, 0),
    "hex": (r"[0-9a-f]+", 0, 24, 0),
}
HEX = "0123456789abcdef" * 2


def plain(text):
    out = []
    for rank, (kind, (pattern, group, least, flags)) in enumerate(KINDS.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


TEXTS = [
    None,
    "",
    'é😀 token = "' + HEX + '" end \x01\x02 secret: abc',
    "password: token: abcdef PASSWORD=token=abcdefgh Api_Key:'zzzzzz' apikey = \"a.b-c/d\"",
    "AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 16 + " AKIAshort AKIA",
    HEX + "g" + HEX[:23] + "g" + HEX[:24],
    f"secret={HEX} {HEX}",
    "ſecret=abcdefgh toKen=abcdefgh",
    "x " * 50_000 + "passwd=hunter22",
    "password = a" * 500,
    "token=" + HEX + HEX,
    "api__key=abcdefg\npassword\n=abcdef password=\tabcdef",
]


def run(spark, texts, **options):
    rows = [(i, t, None, f"s{i}", None, 1, "b", "v") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect()}


def test_base_spans(spark):
    got = run(spark, TEXTS)
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = plain(text)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))
        for kind in KINDS:
            assert got[i][f"n_{kind}"] == want.count(kind)


def test_ownership(spark):
    key = "Zx9" * 8
    texts = [f"see {key} here"] * 2 + [f"only Own{i}er77Key88Long99Value here" for i in range(2)] + ["Wide1Wide2Wide3Wide4Wide5 x"] * 5
    texts += ["password=samevalue"] * 5 + ["word" * 8]
    got = run(spark, texts)
    assert [got[i].n_bare for i in range(9)] == [1, 1, 1, 1, 0, 0, 0, 0, 0]
    assert got[0].spans == f"bare:4:{4 + len(key)}"
    assert [(got[i].n_assign, got[i].n_live, got[i].n_example) for i in range(9, 14)] == [(1, 0, 1)] * 5
    assert got[14].spans == "" and got[14].n_live == 0


def test_repeated_and_null_ids_and_empty(spark):
    rows = [(i, "token=abcdef", None, None, None, 1, "b", "v") for i in (1, 1, None)]
    got = scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.n_assign, r.spans) for r in got] == [(1, "assign:0:12")] * 3
    assert scan_secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_text_of_very_many_spans(spark):
    import time

    text = " ".join(f"{i:024x} Own{i:08d}Zx{i:08d}" for i in range(20_000)) + " token=abcdef1234567890abcdefXY"
    run(spark, ["warm"])
    began = time.time()
    got = run(spark, [text])[0]
    assert time.time() - began < 20
    assert got.base_sha256 == hashlib.sha256(plain(text).encode()).hexdigest() and (got.n_hex, got.n_bare) == (20_000, 20_000)


def test_bare_spans_meet_no_base_span(spark):
    """Against every pair of spans."""
    import random

    draw = random.Random(3)
    parts = [HEX, "Abc1" * 6, "token=", " ", "g", "=", "/", "AKIA" + "Q7" * 9, '"', "zz9" * 7]
    texts = ["".join(draw.choice(parts) for _ in range(30)) for _ in range(60)]
    got = run(spark, texts, most_owners=100)
    for i, text in enumerate(texts):
        base = [tuple(map(int, s.split(":")[1:])) for s in plain(text).split(",") if s]
        bare = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
        want = [s for s in bare if not any(a < s[1] and s[0] < b for a, b in base)]
        assert [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",") if s.startswith("bare")] == want


def test_copies_of_a_text_are_one_repository(spark):
    texts = ["see " + "Zx9" * 8] * 150
    rows = [(i, t, None, "one", None, 1, "b", "v") for i, t in enumerate(texts)]
    got = scan_secrets(spark.createDataFrame(rows, SCHEMA), most_repos=1).collect()
    assert all(r.n_bare == 1 and r.n_live == 1 for r in got)


def test_owners_and_repositories_come_out(spark):
    rows = [(1, "token=abcdef", None, "one"), (2, "see token=abcdef", None, "one"), (3, "token=abcdef", None, "two"), (4, "token=zzzzzz token=abcdef", None, None), (5, "nothing", None, "one"), (6, "token=yyyyyy", None, "one")]
    got = {r.doc_id: (r.n_owners, r.n_repos) for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    # Equal texts are one repository of each owner that has them.
    assert got == {1: (3, 4), 2: (3, 4), 3: (3, 4), 4: (3, 4), 5: (0, 0), 6: (1, 1)}
