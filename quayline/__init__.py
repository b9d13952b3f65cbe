"""Landing-zone ingestion and log analytics as Spark jobs.

Every public function takes and returns DataFrames or Columns, so Catalyst sees
one plan from the scan to the result.  Nothing here collects rows on the driver.
"""
