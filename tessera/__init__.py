"""tessera: ETL stage operators expressed as Spark DataFrame plans.

Every operator is a plain function DataFrame(s) -> DataFrame(s) whose work
runs on executors; nothing passes whole through the driver.
"""

__version__ = "0.1.0"
