"""Doctors in text: names that prove themselves."""

import pytest

from folioscope.functions.doctors import doctors_in_text, readings


def read(text):
    return [r[0] for r in readings(text)]


@pytest.mark.parametrize(
    ("line", "names"),
    [
        ("Лікар: Відділення", []), ("Лікар: Замовлення", []), ("Médico: Colaborador", []), ("Лікар: Бережницький А.В.", ["Бережницький А.В."]), ('ЛІКАРНЯ "Соловейко"', []),
        ("Соловейківська міська клінічна лікарня № 97", []), ("Лікарняний лист видано пацієнтові Бережницький А.В.", []), ("Направлено : 02.03.2026  № напр.:09767  Спеціаліст: Уролог  Лікар:  Бережницький А.В  Виконано", ["Бережницький А.В"]),
        ("Завідуюча КДЛ Михалевич", []), ("Лікар Бережницький Орися Степанівна", ["Бережницький Орися Степанівна"]), ("Зав. відділенням Бережницький", []), ("Лікар Ставничук", []),
        ("Науковий керівник доктор медичних наук А.В.Бережницький т. 2471495", []), ("Зав. відділенням    к.м.н.  [підпис]  О.П.Ставничук", ["О.П.Ставничук"]), ("ΠΑΡΑΠΕΜΠΩΝ ΙΑΤΡΟΣ: Dr. Anna Smith", []),
        ("Направив лікар Бережницький А.В.", []), ("Лікар Коваль О.П. направив Петренко І.І.", ["Коваль О.П."]), ("DRA. MARTA OLIVERA", ["MARTA OLIVERA"]), ("seen by Dr. Anna Smith today", ["Anna Smith"]),
        ("Dr Marta Olivera Personal Doctor", []), ("AR (Mydr.) Anna Smith", []), ("Врач: КДЦ Іваненко  І. І.", ["Іваненко І. І."]), ("", []), (None, []),
    ],
)
def test_readings(line, names):
    assert read(line) == names


def test_table_function(spark):
    rows = [(1, "Лікар: Коваль О.П.\nDr. Anna Smith; Лікар: Коваль О.П."), (2, None), (3, "nobody"), (4, "Лікар: Коваль О.П.")]
    got = sorted((r.document_id, r.name, r.label, r.shape) for r in doctors_in_text(spark.createDataFrame(rows, "document_id long, text string")).collect())
    assert got == [(1, "Anna Smith", "Dr", "latin"), (1, "Коваль О.П.", "Лікар", "surname_then_initials"), (1, "Коваль О.П.", "Лікар", "surname_then_initials"), (4, "Коваль О.П.", "Лікар", "surname_then_initials")]
