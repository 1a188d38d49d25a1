"""corvidex: a text-and-ticket analytics engine written as Spark DataFrame programs."""
