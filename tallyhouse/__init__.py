"""tallyhouse: a stock ledger and invoicing engine on Spark DataFrames.

Tables are DataFrames; operators are functions DataFrame -> DataFrame built
from Spark SQL functions (no Python UDFs). See README.md for the operator map.
"""

__version__ = "0.1.0"
