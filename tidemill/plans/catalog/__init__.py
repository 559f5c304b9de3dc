"""Every registered query with, where SQL can say the same, its check."""

from __future__ import annotations

from tidemill.plans.catalog import categories, cleaning, modelling, profiles, tables
from tidemill.plans.catalog.common import GAPPY_EVENTS, gappy_events
from tidemill.plans.prepare import prepare_events

FLAGSHIP = f"""WITH {GAPPY_EVENTS}, f AS (SELECT event_type, coalesce(value, (SELECT median(value) FROM gappy_events))
        AS value FROM gappy_events),
    b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
    k AS (SELECT f.* FROM f, b WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
    SELECT event_type, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM k) AS DOUBLE), 6) AS share,
        round(avg(value), 4) AS mean_value FROM k GROUP BY event_type"""

CATALOG = {
    "prepare_events": (lambda spark, d: prepare_events(gappy_events(spark, d)), FLAGSHIP),
    **tables.QUERIES, **cleaning.QUERIES, **profiles.QUERIES, **categories.QUERIES, **modelling.QUERIES,
}
