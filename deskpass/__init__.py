"""deskpass: request-decision and text-retrieval analytics on Spark DataFrames.

Every public function takes and returns DataFrames or Columns; nothing is
collected to the driver.
"""

__version__ = "0.1.0"
