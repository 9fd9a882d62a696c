"""tallyloom: filings analytics and valuation as Spark jobs."""
