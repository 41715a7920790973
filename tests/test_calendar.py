from datetime import date, timedelta

from tidemark.plans.models import dim_date


def test_date_dimension_against_python(spark):
    rows = dim_date(spark).orderBy("date_day").collect()
    assert len(rows) == 3653
    assert (rows[0].date_day, rows[-1].date_day) == (date(2016, 1, 1), date(2025, 12, 31))
    for i, row in enumerate(rows):
        day = date(2016, 1, 1) + timedelta(days=i)
        _, week, weekday = day.isocalendar()
        assert tuple(row) == (
            int(day.strftime("%Y%m%d")),
            day,
            day.year,
            (day.month + 2) // 3,
            day.month,
            day.strftime("%b"),
            week,
            day.day,
            weekday,
            day.strftime("%a"),
            weekday >= 6,
        )
