"""assay: detector evaluation and dataset forensics as Spark jobs."""
