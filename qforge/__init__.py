"""qforge: corpus preparation and evaluation for answer-aware question
generation, written as Spark DataFrame / Column operators.

Every operator is either ``DataFrame -> DataFrame`` (usable with
``df.transform``) or ``Column -> Column``.
"""

__version__ = "0.1.0"
