"""admeter: paid-media performance analytics as Spark DataFrame operators.

Every operator is a plain function ``f(df, **options) -> DataFrame`` and can be
chained with ``DataFrame.transform``.  Nothing runs until an action is called,
except in the few functions whose docstring says "runs a job".
"""

__version__ = "0.1.0"
