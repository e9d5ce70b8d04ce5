"""Dates in lines of five languages."""

from datetime import date

import pytest

from folioscope.functions.dates import day_or_month_first, month_of, quoted_date, read_date
from folioscope.functions.tokens import slips, spelled, tokens

TODAY = date(2026, 9, 17)
D = date


@pytest.mark.parametrize(
    ("text", "language", "want"),
    [
        ("03.02.2026", "el", ("2026-02-03", "day", False)), ("03/02/2026 11:37:48", "en", ("2026-02-03", "day", True)), ("13/02/2026", "en", ("2026-02-13", "day", False)),
        ("02/13/2026", "en", ("2026-02-13", "day", False)), ("«12» 03 2003 г.", "ru", ("2003-03-12", "day", False)), ("«5» марта 2003г.", "ru", ("2003-03-05", "day", False)),
        ("12 березня 2019 р.", "uk", ("2019-03-12", "day", False)), ("3 de febrero de 2026", "es", ("2026-02-03", "day", False)), ("February 3, 2026", "en", ("2026-02-03", "day", False)),
        ("12.03.03", "ru", ("2003-03-12", "day", False)), ("17.05.92", "ru", ("1992-05-17", "day", False)), ("2026-02-03", "en", ("2026-02-03", "day", False)),
        ("с «12» 03 2003 г. по «20» 03 2003 г.", "ru", ("2003-03-12", "day", False)), ("12 12 2002", "uk", ("2002-12-12", "day", False)), ("2007 г.", "ru", ("2007-01-01", "year", False)),
        ("март 2005", "ru", ("2005-03-01", "month", False)), ("12.III.03", "ru", ("2003-03-12", "day", False)), ("12/III-03г.", "ru", ("2003-03-12", "day", False)),
        ("24/УI-92г.", "ru", ("1992-06-24", "day", False)), ("08. 89", "ru", ("1989-08-01", "month", False)), ("12.03", "ru", None), ("5 січня 2008 р.", "uk", ("2008-01-05", "day", False)),
        ("12 квітня 2019", "uk", ("2019-04-12", "day", False)), ("1 листопада 2005 р.", "uk", ("2005-11-01", "day", False)), ("5/ХІ 2001", "uk", ("2001-11-05", "day", False)),
        ("10:30:00 03-02-26", "en", ("2026-02-03", "day", True)), ("32.13.2020", "ru", ("2020-01-01", "year", False)), ("08:30 12.05.2020", "ru", ("2020-05-12", "day", False)),
        ("Стр. 1 из 2  12.05.2020", "ru", ("2020-05-12", "day", False)), ("№ 4517 12.05.2020", "ru", ("2020-05-12", "day", False)), ("Дата 2020.05.12", "ru", ("2020-05-12", "day", False)),
        ("2020/05/12", "ru", ("2020-05-12", "day", False)), ("Палата 12 05.06.2020", "ru", ("2020-06-05", "day", False)), ("10-NOV-2021", None, ("2021-11-10", "day", False)),
        ("9-ago-2011", None, ("2011-08-09", "day", False)), ("9-лип-2011", None, ("2011-07-09", "day", False)), ("09/JUL/2011", None, ("2011-07-09", "day", False)),
        ("8 Μαΐου 2019", None, ("2019-05-08", "day", False)), ("8 ΜΑΪΟΥ 2019", None, ("2019-05-08", "day", False)), ("8 ΜΑΙΟΥ 2019", None, ("2019-05-08", "day", False)),
        ("1º de marzo de 2019", None, ("2019-03-01", "day", False)), ("3,89-5,84", None, None), ("менее 5", None, None), ("ТТГ 4.12 від 19 січня 2019 р.", None, ("2019-01-19", "day", False)),
        ("TSH 4,12 de 19 de enero de 2019", None, ("2019-01-19", "day", False)), ("ΤΣΗ 4.12 στις 19 Ιανουαρίου 2019", None, ("2019-01-19", "day", False)),
        ("TSH 4.12 from Jan 19, 2019", None, ("2019-01-19", "day", False)), ("ТТГ 4.12 від січня 2019", None, ("2019-01-01", "month", False)), ("5 6 2019", "uk", ("2019-06-05", "day", False)),
        ("15 квiтня 2019", None, ("2019-04-15", "day", False)), ("map 2019", None, ("2019-01-01", "year", False)), ("31.02.2019", None, ("2019-01-01", "year", False)), (None, None, None), ("без даты", "ru", None),
    ],
)
def test_read(text, language, want):
    got = read_date(text, TODAY, language)
    assert (got and (got["value"].isoformat(), got["precision"], got["ambiguous"])) == want


def test_day_or_month_first():
    cases = {
        "19 05 2020": "day first", "19.05.2020": "day first", "02/28/2020": "month first", "05/06/2020": None, "19.05-2020": None,
        "08:30 12.05.2020": None, "2020-05-19": None, None: None,
    }
    assert {t: day_or_month_first(t, TODAY) for t in cases} == cases


@pytest.mark.parametrize(
    ("line", "document", "want"),
    [
        ("PSA (03.03.2017) 6,21 ng/ml", D(2019, 11, 5), D(2017, 3, 3)), ("09.09.2011 Глікований гемоглобін 7.4  (4,0-6,0)", D(2019, 1, 9), D(2011, 9, 9)),
        ("ПСА-4,18 (07.2014)", D(2019, 1, 14), D(2014, 7, 1)), ("ПСА-4,18 нг/мл (07.2014: Invented Lab)", D(2019, 1, 14), D(2014, 7, 1)),
        ("УЗО від 05.2013 - простата 31см3", D(2016, 2, 26), D(2013, 5, 1)), ("ТТГ 3.47 від 11.02.15 р.", D(2019, 7, 1), D(2015, 2, 11)),
        ("ТТГ 3.47 від 11.2.15 р.", D(2019, 7, 1), None), ("ТТГ 3.47 від 1.02.15 р.", D(2019, 7, 1), None), ("ТТГ 3.47 від 1.2.2015 р.", D(2019, 7, 1), D(2015, 2, 1)),
        ("TSH 4.12 from 3/15/2019", D(2021, 7, 6), D(2019, 3, 15)), ("Еналаприл 10/20/19 мг", D(2021, 7, 6), None), ("TSH 4.12 from 09/07/2011", D(2021, 7, 6), D(2011, 7, 9)),
        ("Зразок взято 03.03.2026, ТТГ 3.47", D(2026, 3, 3), None), ("взято 05.03.2026", D(2026, 3, 12), None), ("щось 11.11.1899 щось", D(2020, 1, 1), None),
        ("направлення 01.01.2031", D(2015, 1, 1), None), ("щось 45.13.2015 щось", D(2020, 1, 1), None), ("щось 11.02.15 щось", D(2020, 1, 1), D(2015, 2, 11)),
        ("щось 11/02/15 щось", D(2020, 1, 1), D(2015, 2, 11)), ("щось 11.02-15 щось", D(2020, 1, 1), None), ("щось 11-02.15 щось", D(2020, 1, 1), None),
        ("ΤΣΗ 4.12 στις 12.2019", D(2021, 7, 6), D(2019, 12, 1)), ("ΤΣΗ 4.12 ΣΤΙΣ 12.2019", D(2021, 7, 6), D(2019, 12, 1)), ("Дата: 12.2019 ТТГ 4.12", D(2021, 7, 6), D(2019, 12, 1)),
        ("ТТГ 4.12 с 12.2019", D(2021, 7, 6), D(2019, 12, 1)), ("ТТГ 4.12 вiд 12.2019", D(2021, 7, 6), D(2019, 12, 1)), ("Дата народження: 12.1975 ТТГ 4.12", D(2021, 7, 6), None),
        ("Коефіцієнт норма 1.2019 умовних одиниць", D(2021, 7, 6), None), ("TSH 4.12, 10-NOV-2019", D(2021, 7, 6), D(2019, 11, 10)), ("ТТГ 4.12 з 19.ІХ.2019", D(2021, 7, 6), D(2019, 9, 19)),
        ("ТТГ 4.12 19 січня 2019 р.", D(2021, 7, 6), D(2019, 1, 19)), ("ΤΣΗ 4.12 στις 8 ΜΑΪΟΥ 2019", D(2021, 7, 6), D(2019, 5, 8)), ("Феритин 23 нг/мл march 2019", D(2021, 7, 6), None),
        ("ТТГ 4.12 від січня 2019", D(2021, 7, 6), D(2019, 1, 1)), ("ТТГ 4.12 (січня 2019)", D(2021, 7, 6), D(2019, 1, 1)), ("", D(2020, 1, 1), None), (None, D(2020, 1, 1), None), ("11.02.2015", None, None),
        ("Холестерин заг 29.03.19р.-5.1", D(2021, 7, 6), D(2019, 3, 29)),
    ],
)
def test_quoted(line, document, want):
    assert quoted_date(line, document) == want


@pytest.mark.parametrize(
    "line",
    [
        "Глюкоза 5.31 4.10-5.90 ммоль/л", "Нейтрофіли (абс.) 4.21 1.80-7.70 x10 9 /л", "Cistatina C suero 0.812 mg/L 0.21-1.95", "* 10203-4   Cystatin C 0.9 mg/L 0.55-1.15 mg/L  20 - 59 y.o.",
        "Сечовина..........6.4  (2.50-8.30 мМоль/л)", "низький нормальний 2.10-6.40 високий 7.20 ммоль/л", "K:14/3/2/47/ 15  R2D", "Коефіцієнт 1.2024 умовних одиниць", "Феритин 23 нг/мл (норма 4-2000)",
        "Φερριτίνη 23 ng/ml (τιμές 4-2000)", "4-2000 нг/мл феритин 23", "IgE от 5-2015 МЕ/мл", "по 1 таблетці 3 рази на день 5-7-10 днів", "Еналаприл 5/10/20 мг", "Епітелій 2-3-19 в полі зору", "Vis 6/9/18",
        "2.1.19 Загальні показники", "аналізатор версія v5.2.19", "Лейкоцити 5 х 10 9/л", "Лейкоцити 5.5 х 10 9/л", "Еритроцити 4,5 х 1012/л", "WBC 6.4 x 10 9/L",
    ],
)
def test_no_date_in_ranges_doses_and_formulas(line):
    assert quoted_date(line, D(2021, 7, 6)) is None


def test_slips():
    assert slips("вiд") and "cіч" in slips("січ") and slips("a") == [] and slips("5") == []
    table = spelled({"mg": ["mg/l"], "ug": ["μg/l"], "year": ["рік"]})
    assert table["mg/l"] == "mg" and table["μg/l"] == "ug" and table["piк".replace("p", "р")] == "year"
    clash = spelled({1: ["сам"], 2: ["сaм"]})  # the second is a slip of the first, and stays what it is
    assert clash["сам"] == 1 and clash["сaм"] == 2 and all(clash.get(s) != 1 for s in slips("сaм") if s not in ("сам",))
    assert month_of("сiчня") == 1 and month_of("map") is None and month_of("ΦΛΕΒΑΡΗ") == 2


def test_tokens():
    assert [(t.kind, t.text, t.gap) for t in tokens("«5» Марта,2003г")] == [("n", "5", True), ("w", "марта", True), ("s", ",", False), ("n", "2003", False), ("w", "г", False)]
    assert tokens("") == []
