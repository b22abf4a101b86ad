"""Where the tables that tests read lie."""

SF = "/root/testdata/sf0.001"
