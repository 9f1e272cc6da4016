"""An inventory of cryptographic API use in Python source trees, as Spark jobs."""
