"""One object per data set with a method per question; every answer is a DataFrame."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import (
    evaluate, forecast, incidents, kpivalues, measures, quality, rollup, rootcause, scenario,
    seriesstats, views)
from tidemark.plans.registry import SHIPPED_SPECS, spec_frame
from tidemark.schemas import SCENARIO
from tidemark.sources import sinks


class Monitor:
    """Questions about one order data set.

    ``source`` offers ``orders, payments, items, reviews, customers, products, translation``
    and ``asof``: a ``StarSchema``, or a ``Mart`` of the supplied test tables. ``specs``
    replaces the shipped metric configuration.
    """

    def __init__(self, source, specs: list[dict] | None = None):
        self.source = source
        self.spark = source.orders.sparkSession
        self.specs = SHIPPED_SPECS if specs is None else specs

    # metrics

    def kpis(self, segment: str | None = None) -> DataFrame:
        """Verdicts at the anchor day, per ``segment`` (a customer column) if given.

        A spec with a ``sql_query`` over the registered views uses that, whatever its name; the
        others must be named like a built-in metric.
        """
        s = self.source
        builtin = {*kpivalues.DAY_KPIS, *kpivalues.DELIVERY_KPIS, *kpivalues.CUSTOMER_KPIS}
        values = kpivalues.kpi_values(s.orders, s.payments, s.customers, s.asof,
                                      s.asof - timedelta(days=evaluate.MONTH_DAYS), segment)
        own = [spec for spec in self.specs
               if spec.get("sql_query") or spec.get("name") not in builtin]
        shipped = [spec for spec in self.specs if spec not in own]
        status = evaluate.evaluate(values, spec_frame(self.spark, shipped), s.asof)
        if own:
            self.register()
            extra = evaluate.evaluate_sql(self.spark, own, spec_frame(self.spark, own), s.asof)
            status = status.unionByName(extra, allowMissingColumns=True)
        return status

    def board(self) -> DataFrame:
        return evaluate.display_rows(self.kpis())

    def summary(self) -> DataFrame:
        return evaluate.run_summary(self.kpis())

    def alerts(self, segment: str | None = None) -> DataFrame:
        return evaluate.alerts(self.kpis(segment))

    def register(self) -> None:
        """Base tables and reporting views as SQL views."""
        s = self.source
        for name in ("orders", "payments", "items", "reviews", "customers", "products"):
            getattr(s, name).createOrReplaceTempView(name)
        views.register_views(self.order_fact(), views.daily_summary(s.orders, s.payments))

    # data quality

    def audit(self) -> DataFrame:
        s = self.source
        return quality.audit(s.orders, s.payments, s.reviews)

    def health(self) -> DataFrame:
        return quality.health(self.audit(), self.source.orders)

    def record_audit(self, path: str, run: datetime) -> None:
        sinks.append_audit(quality.audit_log(self.audit(), run), path)

    def clean(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        s = self.source
        return quality.remediate(s.orders, s.payments, s.items)

    # series

    def series(self, lookback: int, segment: str | None = None) -> DataFrame:
        s = self.source
        orders = s.orders
        if segment:
            orders = orders.join(s.customers.select("customer_id", segment), "customer_id",
                                 "left")
        return rollup.to_series(rollup.daily_rollup(orders, s.payments, s.asof, lookback,
                                                    segment))

    def trends(self, segment: str | None = None, lookback: int = 60) -> dict[str, DataFrame]:
        series = self.series(lookback, segment)
        stats = seriesstats.series_stats(series)
        return {"stats": stats, "anomalies": seriesstats.anomalies(series, stats),
                "timeline": seriesstats.timeline(series)}

    def forecast(self, days: int = 7, segment: str | None = None) -> dict[str, DataFrame]:
        series = self.series(45, segment).filter("metric in ('revenue', 'volume')")
        fits = forecast.fit(series)
        return {"forecast": forecast.project(fits, days),
                "direction": forecast.trend_direction(fits),
                "warnings": forecast.early_warnings(fits, days),
                "errors": forecast.too_short(fits)}

    def what_if(self, price: float = 0.0, churn: float = 0.0, delay: float = 0.0) -> DataFrame:
        s = self.source
        base = scenario.baseline(s.orders, s.payments, s.asof)
        grid = self.spark.createDataFrame([(float(price), float(churn), float(delay))], SCENARIO)
        return scenario.project(base, grid)

    # drivers

    def diagnose(self) -> dict[str, DataFrame]:
        s = self.source
        shift = rootcause.state_shift(s.orders, s.customers, s.payments, s.asof)
        driver = rootcause.top_driver(shift)
        paid = rootcause.payment_diagnostics(s.payments, s.orders, s.asof)
        slow = rootcause.logistics_delays(s.orders, s.customers, s.asof)
        return {"regions": rootcause.regional_breakdown(shift),
                "categories": rootcause.category_performance(
                    s.items, s.orders, s.products, s.translation, s.asof),
                "payments": paid, "logistics": slow, "driver": driver,
                "recommendations": rootcause.recommendations(driver, paid, slow)}

    # reporting

    def order_fact(self) -> DataFrame:
        s = self.source
        return views.order_fact(s.orders, s.customers, s.payments, s.reviews)

    def measures(self, by: list[str] | None = None) -> DataFrame:
        return measures.measures(self.order_fact(), by)

    def export(self, folder: str, audit_log: DataFrame | None = None) -> DataFrame:
        """The four extracts as CSV; without an audit log that extract is empty."""
        s = self.source
        if audit_log is None:
            audit_log = quality.audit_log(self.audit(), datetime.combine(
                s.asof, datetime.min.time())).limit(0)
        return sinks.export_csv({
            "orders": views.recent_order_fact(s.orders, s.customers, s.payments, s.reviews,
                                              s.asof),
            "daily_kpis": views.daily_extract(s.orders, s.payments),
            "data_quality": quality.newest_audits(audit_log),
            "regional": views.regional_summary(s.orders, s.customers, s.payments, s.reviews,
                                               s.asof)}, folder)

    # incidents

    def incidents(self, log: DataFrame, n: int = 20) -> DataFrame:
        """Newest incidents of an event log together with today's alerts."""
        today = incidents.alert_events(self.alerts())
        return incidents.newest(incidents.fold(log.unionByName(today)), n)
