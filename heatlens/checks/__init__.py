"""Every operator as a query over the test tables, with its SQL twin."""
