"""marginalia: bulk quotation and citation checking as Spark jobs."""
