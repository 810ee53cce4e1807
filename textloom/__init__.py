"""A text-clustering engine on Spark: normalise, vectorise, cluster, describe and project texts."""
