"""Where the tests read the given tables."""
SF_SMALL = "/root/testdata/sf0.001"
