"""Plans: the query catalog (Spark builders + equivalent oracle SQL)."""
