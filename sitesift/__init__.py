"""sitesift: Spark-native discovery, crawling-text analytics and qualification of business websites."""
