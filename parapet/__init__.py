"""Package-risk analytics on Spark: findings are rows of one signals relation."""
