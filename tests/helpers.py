def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
