"""Short lines are read once while a worker remembers them, and read the same."""

from datetime import date

from folioscope.functions import dates, doctors, person


def test_a_line_is_read_once_for_all_days_of_a_year():
    dates._told_kept.cache_clear()
    line = "ТТГ 4.12 від 03.02.2015 р., ПСА (05.04.2014) 6"
    got = [dates.quoted_date(line, date(2015, 3, d)) for d in range(1, 29)]
    assert got[0] == date(2014, 4, 5) and got[-1] == date(2015, 2, 3)
    assert got == [next((x for x in dates._told(line, 2015) if (date(2015, 3, d) - x).days > 31), None) for d in range(1, 29)]
    assert dates._told_kept.cache_info().misses == 1
    assert dates.quoted_date(line, date(2016, 3, 1)) == date(2015, 2, 3) and dates._told_kept.cache_info().misses == 2
    assert dates.quoted_date("x " * dates.KEPT_CHARS + line, date(2016, 3, 1)) == date(2015, 2, 3) and dates._told_kept.cache_info().misses == 2


def test_doctors_and_births_are_remembered_by_line_and_page():
    doctors._of_line_kept.cache_clear()
    page = "Form 5\nЛікар: Мельник А.В.\nend\nЛікар: Мельник А.В."
    assert [r[0] for r in doctors.readings(page)] == [r[0] for r in doctors.readings(page)] == ["Мельник А.В."] * 2
    assert doctors._of_line_kept.cache_info().misses == 3
    person._birth_dates_kept.cache_clear()
    born = "Date of birth: 1961-02-03"
    assert [list(person._birth_dates_kept(born, date(2020, 1, 1))) for _ in range(3)] == [[date(1961, 2, 3)]] * 3
    assert person._birth_dates_kept.cache_info().misses == 1
