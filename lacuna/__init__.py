"""Spark jobs for spatial-graph segmentation; every public function is DataFrame in, DataFrame out."""
