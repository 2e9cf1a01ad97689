"""kinweft: pedigree analytics and record-linkage operators on Apache Spark."""

__version__ = "0.1.0"
