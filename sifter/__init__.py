"""sifter: operational analytics as Spark DataFrame operators.

Raw tables of uneven quality go in; canonical records, validation results,
profiles, chart aggregates, anomaly flags, forecasts and model metrics come
out.  Every operator is a ``DataFrame -> DataFrame`` function planned by
Catalyst; nothing is pulled to the driver except bounded summaries.

The submodules are the API::

    from sifter.sources import readers, store
    from sifter.operators import reshape, validate, profile, charts, anomaly, forecast, metrics
    from sifter.plans import pipeline
"""

__version__ = "0.1.0"
